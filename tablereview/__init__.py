"""Dataset review on Spark: profile, findings, features, model comparison, decision.

Every stage takes and returns DataFrames; see ``tablereview.plans.review`` for
the whole run and the modules in ``tablereview.operators`` for single stages.
"""

__version__ = "0.1.0"

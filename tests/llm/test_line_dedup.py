import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from tablereview.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least_chars=40, least_docs=5):
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc_id)
    common = {
        k: max(ids, key=lambda i: (i is not None, i)) for k, ids in held.items() if len(k) >= least_chars and len(ids) >= least_docs
    }
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if common.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs, **limits):
    return sorted([tuple(r)[:4] for r in line_dedup.digest(docs, **limits).collect()], key=str)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_matches_brute_force(documents):
    rows = rows_of(documents)
    for limits in ({}, {"least_chars": 3, "least_docs": 2}):
        assert got(documents, **limits) == brute(rows, **limits)


LINE = "This Line stands in very many documents of the whole table É"


def shared(spark, n):
    rows = [(i, f"own {i}\n {LINE}\t\n{LINE.lower().replace('é', 'É')}\nend") for i in range(n)]
    rows += [(n + 5, "short\n" + "\n".join(f"line {k} of a long text" for k in range(1000)) + f"\n{LINE.upper()}")]
    rows += [(n + 9, LINE.replace("É", "é"))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_line_shared_by_all(spark):
    docs = shared(spark, 600)
    assert got(docs) == brute(rows_of(docs))
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert kept[7] == "own 7\nend" and kept[605].endswith(LINE.upper()) and kept[609] == LINE.replace("É", "é")


def test_bitmaps_say_which_lines_stay(spark):
    lines = [LINE if k % 130 in (64, 129) else f"line number {k}" for k in range(1000)]
    rows = [(k, LINE) for k in range(10, 15)] + [(1, "\n".join(lines))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep = next(r for r in line_dedup.keep_bitmaps(docs).collect() if r.id == 1)
    bits = [(keep.keep[k // 64] >> (k % 64)) & 1 if k // 64 < len(keep.keep) else 1 for k in range(1000)]
    assert bits == [int(x != LINE) for x in lines] and keep.n_dropped == bits.count(0)


def test_a_shared_line_is_sorted_in_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = line_dedup.long_lines(shared(spark, 20_000), "doc_id", "text", 40).cache()
        slices = lines.repartitionByRange(8, "h1", "h2", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(line_dedup.SLICES)))
        sizes = [r["count"] for r in slices.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.4 * sum(sizes)
        often = line_dedup.common_lines(lines, 5).collect()
        assert [(r.docs, r.keeper) for r in often] == [(20_001, 20_005)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_streams_need_no_second_shuffle(spark, documents):
    lines = line_dedup.long_lines(documents, "doc_id", "text", 40)
    plan = line_dedup.streamed(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_odd_rows(spark, odd, none):
    for limits in ({}, {"least_chars": 1, "least_docs": 2}):
        assert got(odd, **limits) == brute(rows_of(odd), **limits)
    kept = line_dedup.drop_repeated_lines(odd, least_chars=1, least_docs=2)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert kept.filter("doc_id = 1 and text is null").count() == 1
    assert got(none) == [] and line_dedup.drop_repeated_lines(none).count() == 0

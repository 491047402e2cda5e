from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from surveyloom.llm.pfair import mix_sources


def test_no_source_is_a_block_off_its_unrounded_target_beyond_ten_thousand_slots(spark):
    blocks = {"a": 16000, "b": 9000, "c": 4000, "d": 300, "e": 10, "f": 1}
    docs = spark.range(sum(blocks.values())).select(F.col("id").alias("doc_id"), F.lit(8).alias("n_bytes"))
    edge, source = 0, F.lit(None)
    for name, n in blocks.items():
        source = F.when((F.col("doc_id") >= edge) & (F.col("doc_id") < edge + n), name).otherwise(source)
        edge += n
    rows = mix_sources(docs.withColumn("source", source), F.col("n_bytes"), block_size=8).select("source", "slot", "pass_no").collect()
    total = sum(n**0.9 for n in blocks.values())
    assert len(rows) > 20_000 and sorted(r.slot for r in rows) == list(range(len(rows)))
    assert Counter(r.source for r in rows if r.pass_no == 0) == Counter(blocks)
    had = Counter()
    for r in sorted(rows, key=lambda r: r.slot):
        had[r.source] += 1
        if r.slot % 97 == 0 or r.slot == len(rows) - 1:
            assert all(abs(had[s] - (r.slot + 1) * n**0.9 / total) < 1 for s, n in blocks.items())

"""Ranges of the capture index follow the number of pages."""

import hashlib

from pyspark.sql import functions as F

from foliospark.llm import warc


def test_ranges_follow_the_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 25)
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.example/%d", F.col("id") % 9, F.col("id")).alias("url"), F.format_string("<p>%d</p>", F.col("id") % 700).alias("html"))
    keyed = pages.select(warc.lines_key(F.col("url")).alias("key"), "page_id")
    bounds = warc.ranges(keyed)
    assert 35 <= len(bounds) <= 40 and bounds == sorted(set(bounds))
    assert len(warc.ranges(keyed, most=5)) <= 5 and warc.ranges(keyed.limit(0)) == []
    index = warc.write_archives(pages)
    assert index.select("part").distinct().count() == len(bounds)
    found = warc.look_up(index, pages.select("url"))
    got = {r.page_id: (r.record_type, bytes(r.body or b"")) for r in found.collect()}
    assert len(got) == 1000
    for i, (kind, body) in got.items():
        last = max(j for j in (i % 700, i % 700 + 700) if j < 1000)
        assert kind == ("response" if i == last else "revisit")
        assert i != last or hashlib.sha1(body).digest() == hashlib.sha1(f"<p>{i % 700}</p>".encode()).digest()

"""Quality rules and sharding."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from glossmill.llm import oracles, quality_rules, queries, sharding


def test_quality_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(oracles.ORACLES["op9_quality_rules"])
    names = [x[0] for x in want.description]
    got = queries.op9_quality_rules(spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


def test_quality_odd(spark, odd, none):
    got = quality_rules.clean_lines(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and not by[1].kept and by[1].cleaned_text == ""
    assert by[6].n_words == 30_000 and by[6].kept and by[6].key == "c"
    assert quality_rules.clean_lines(none).count() == 0


def test_lines(spark):
    text = "A plain line of words that ends well.\nHome | About | News | Contact\nno end here\nWe use cookies to improve.\n\nwow!! such!! marks!! here!!"
    row = quality_rules.clean_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"), min_words=1).first()
    assert row.cleaned_text == "A plain line of words that ends well.\n"


def least_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, now = (lo + hi) // 2, 1, 0
        for s in sizes:
            if now + s > mid:
                used, now = used + 1, 0
            now += s
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize(("n", "shards", "bits"), [(1, 4, 2), (7, 3, 1), (400, 7, 2), (3000, 40, 4)])
def test_minimax(spark, n, shards, bits):
    rng = random.Random(n)
    keys = sorted({rng.getrandbits(64) - 2**63 for _ in range(n)})
    sizes = [rng.choice([1, 5, 20, 400 if n < 500 else 30]) for _ in keys]
    groups = spark.createDataFrame([(k, s, 1) for k, s in zip(keys, sizes, strict=True)], "key bigint, bytes bigint, rows bigint")
    cuts, capacity, rows = sharding.plan_cuts(groups, shards, bits, 3)
    assert capacity == least_capacity(sizes, shards) and rows == len(keys)
    edges = [c for c in cuts if c is not None]
    parts = np.bincount(np.searchsorted(edges, keys, side="right"), weights=sizes, minlength=shards)
    assert parts.max() <= capacity and edges == sorted(edges)


def test_shards(spark, documents, sf_dir):
    rows = queries.op6_shard(spark, sf_dir).collect()
    texts = dict(documents)
    assert len(rows) == len(documents)
    of, slots = {}, {}
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        assert of.setdefault(t, r.shard) == r.shard and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_odd(spark, odd, none):
    rows = sharding.shard_documents(odd, 4, rows_a_slot_group=1).collect()
    assert len(rows) == 10
    assert len({r["shard"] for r in rows if r.doc_id in (1, 2)}) == 1
    assert sharding.shard_documents(none).count() == 0


def test_boilerplate_of_four_languages(spark):
    """Phrases go whole, whatever their case; words that only begin like one, and prose, stay."""
    gone = ["All Rights Reserved.", "Diese Seite verwendet Cookies.", "© 2020. TOUS DROITS RÉSERVÉS!", "Lea la Política de privacidad.", "Copyright 1999.", "Voir les conditions d’utilisation."]
    stay = ["The cookies were copyrighted by a baker.", "She subscribed to no opinion.", "Powered bygones are gone.", "A " + "long " * 45 + "line on terms of use goes on."]
    row = quality_rules.clean_lines(spark.createDataFrame([(1, "\n".join(gone + stay))], "doc_id int, text string"), min_words=1).first()
    assert row.cleaned_text.split("\n") == stay
    row = quality_rules.clean_lines(spark.createDataFrame([(1, "Own phrase here.\nAll rights reserved.")], "doc_id int, text string"), min_words=1, phrases={"x": ["own phrase"]}).first()
    assert row.cleaned_text == "All rights reserved."


def test_query_shards_are_minimax(spark, sf_dir):
    """The registered shards: no cut of the same order into as many runs has a smaller largest one."""
    rows = queries.op6_shard(spark, sf_dir).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), []).append(r)
    of = {}
    for r in rows:
        of.setdefault(r.shard, 0)
        of[r.shard] += r.size
    assert set(of) <= set(range(40)) and sorted(r.slot for r in rows if r.shard == rows[0].shard) == list(range(sum(r.shard == rows[0].shard for r in rows)))
    # equal texts stay together, and shards are runs of one order: a greedy cut at one byte less fails
    assert all(len({r.shard for r in own}) == 1 for own in groups.values())
    largest, total = max(of.values()), sum(of.values())
    assert largest >= total / 40
    assert largest <= total / 40 + max(sum(r.size for r in own) for own in groups.values())

"""Search of many queries: entries are sent once, and texts that hold a query are found by its tokens."""

import itertools
import random

from glossmill.operators import memory


def test_entries_are_sent_once_and_parts_of_words_are_found(spark):
    rng = random.Random(3)
    words = ["an", "ana", "banana", "nab", "ban", "a", "na\tna"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(120)]
    asked = [" ".join(x) for n in (1, 2, 3) for x in itertools.islice(itertools.product(["an", "na", "b", "ban", "nab"], repeat=n), 40)] + ["a  b", "zz", "ana\tna"]
    entries = spark.createDataFrame([(i, t, "en-ar") for i, t in enumerate(texts)], "ord bigint, source string, language_pair string")
    queries = spark.createDataFrame([(i, q, "en-ar") for i, q in enumerate(asked)], "query_id bigint, query string, language_pair string")
    out = memory.search_all(entries, queries, limit=5, block_rows=40)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # queries only

    def score(q, t):
        if q == t:
            return 1.0
        if q in t:
            return min(0.95, 0.6 + 0.35 * len(q) / len(t))
        a, b = set(q.split()), set(t.split())
        return 0.25 * len(a & b) / len(a | b)

    want = []
    for i, q in enumerate(asked):
        found = sorted((-round(score(q, t) * 1e4) / 1e4, o) for o, t in enumerate(texts) if score(q, t) > 0)
        want += [(i, n + 1, o, -s) for n, (s, o) in enumerate(found[:5])]
    assert sorted((r.query_id, r.rank, r.ord, r.score) for r in out.collect()) == want

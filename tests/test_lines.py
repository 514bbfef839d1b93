"""Lines of words: pages stream through a task and are never a group of their own in Python."""

import random
import statistics

from glossmill.operators import segment


def _folded(page, tolerance=2.5):
    lines, anchor = [], None
    for w in sorted(page, key=lambda w: (round(w[4], 1), w[2])):
        if anchor is None or abs(w[4] - anchor) > tolerance:
            lines.append([])
            anchor = w[4]
        lines[-1].append(w)
    for n, ws in enumerate(lines):
        ws.sort(key=lambda w: w[2])
        sizes = [w[6] for w in ws if w[6] is not None]
        yield n, " ".join(w[1] for w in ws), min(w[4] for w in ws), max(w[5] for w in ws), min(w[2] for w in ws), max(w[3] for w in ws), statistics.median(sizes) if sizes else None


def test_pages_stream(spark):
    rng = random.Random(7)
    pages = {1: 40_000, 2: 30, 3: 1, None: 12}  # the first is more than is held at once
    words = []
    for page, n in pages.items():
        for i in range(n):
            top = (i // 9) * 3.0 + rng.choice([0.0, 0.25, 1.25, 2.5])
            words.append((page, f"w{i}", float(i), i + 0.5, top, top + 2, None if page == 2 or i % 5 == 0 else float(i % 7)))
    df = spark.createDataFrame(rng.sample(words, len(words)), "page int, text string, x0 double, x1 double, top double, bottom double, size double")
    out = segment.words_to_lines(df, ["page"])
    assert "InPandas" not in out._jdf.queryExecution().toString()
    want = [(p, *line) for p in pages for line in _folded([w for w in words if w[0] == p])]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))

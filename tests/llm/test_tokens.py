"""Chat formatting, SentencePiece, packing and the language model."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from glossmill.llm import chat, class_lm, packing, queries, sentencepieces
from glossmill.llm.common import signed, text_bytes, word_hashes
from glossmill.llm.tokens import PATTERN, json_tokenizer, vocabulary_path


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_escapes():
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice(["<", "|", "\\", "<|im_end|>", "a", "\n", "n", ">"]) for _ in range(rng.randrange(10)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_chat_round_trip(spark, sf_dir):
    import duckdb

    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'").fetchall()
    said = "<|im_end|><|im_start|>assistant ok"
    by = defaultdict(list)
    for conv, turn, role, text in sorted(rows):
        by[conv].append((role, text))
    by[-1] = [("user", said), ("assistant", said)]
    got = {r.conv_id: r for r in queries.op2_chat(spark, sf_dir).collect()}
    assert set(got) == set(by)
    for conv, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), digest(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want


def test_chat_odd(spark):
    rows = [(1, 0, None, None), (1, None, "assistant", "x\\<|y"), (1, 0, "us\ner", "a"), (1, 0, "us\ner", "a"), (None, 1, "assistant", "é😀"), (2, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "?") for r in rows], "conv_id bigint, turn bigint, role string, text string, ids string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].turns_sha256 == digest([("assistant", "x\\<|y"), ("", ""), ("us\ner", "a"), ("us\ner", "a")])
    assert got[None].loss_chars == 2 and got[2].loss_chars == 0 and got[2].n_turns == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_pattern_is_the_vocabulary_s():
    import public_tokenizers

    assert PATTERN == public_tokenizers.PATTERN


def test_viterbi_is_optimal():
    rng = random.Random(3)
    for _ in range(1500):
        scores = {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 30)) for _ in range(12)}
        text = "".join(rng.choice("ab▁c") for _ in range(rng.randrange(60)))
        best = [0.0] + [-1e18] * len(text)
        for i in range(len(text)):
            for p, s in scores.items():
                if text.startswith(p, i):
                    best[i + len(p)] = max(best[i + len(p)], best[i] + s)
            if text[i] not in scores:
                best[i + 1] = max(best[i + 1], best[i] - 100.0)
        pieces = sentencepieces.Viterbi(scores, -100.0).segment(text)
        assert "".join(pieces) == text and sum(scores.get(p, -100.0) for p in pieces) == best[-1]


def test_runs_change_nothing(documents):
    m = sentencepieces.model(vocabulary_path("piece_bpe_32k.model"))
    total = lambda ids: sum(m.sp.get_score(i) for i in ids)
    for _, t in documents[:12]:
        t = t[:400]
        ids = np.frombuffer(m.encode(t), "<u4").tolist()
        whole = np.frombuffer(m._run(m.sp.normalize(t)), "<u4").tolist()
        assert total(ids) == total(whole) and m.decode(ids) == m.decode(whole) == t


def test_sentencepiece_round_trip(spark, sf_dir, documents):
    got = queries.op3_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(documents) and all(r.round_trip for r in got)


def test_sentencepiece_odd(spark, odd, none):
    back = {r.doc_id: r for r in sentencepieces.decode_documents(sentencepieces.encode_documents(odd)).collect()}
    assert back[1].text == "" and back[1].n_ids == 0 and back[3].text == " \n\t " and back[8].text == "é 日本 😀\x00 \x0b x<|im_end|>"
    assert sentencepieces.encode_documents(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 3000])
def test_plan(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(5, 1.2, n).astype(int) % 1024 + 1, 1, 1024)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    found, used = packing.plan(histogram), Counter()
    for config, times in found:
        assert sum(a * b for a, b in config) <= 1024
        for length, copies in config:
            used[length] += copies * times
    assert used == Counter(histogram)
    least = -(-int(lengths.sum()) // 1024)
    assert least <= sum(t for _, t in found) <= least + 1 + n // 1000


def test_plan_of_halves():
    assert sum(t for _, t in packing.plan({600: 1000, 420: 500, 500: 500})) == 1250


def test_pricing_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = np.unique(rng.integers(3, 20, 5))
        worth = rng.random((3, len(lengths)))
        found, pick = packing.fillings(worth, lengths, 40)
        for x in range(3):
            best = [0.0] * 41
            for c in range(1, 41):
                best[c] = max([best[c - 1], *(best[c - n] + w for n, w in zip(lengths, worth[x], strict=True) if n <= c)])
            got = packing.filling(pick[:, x], lengths.tolist(), 40)
            assert sum(lengths[j] * a for j, a in got.items()) <= 40
            assert sum(worth[x, j] * a for j, a in got.items()) == pytest.approx(best[40]) == pytest.approx(found[40, x])


def histogram_of(documents):
    tokenizer, out = json_tokenizer(vocabulary_path("byte_bpe_50k.json")), Counter()
    for _, t in documents:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        out[n % 1024 or 1024] += 1
    del out[1024]
    return np.array(sorted(out)), np.array([out[x] for x in sorted(out)])


@pytest.mark.parametrize("kind", ["tables", "lognormal", "halves", "few"])
def test_linear_program(kind):
    """The fractional use covers all pieces and is within the stated gap of a bound that holds."""
    import duckdb

    rng, gap = np.random.default_rng(9), packing.GAP
    if kind == "tables":
        lengths, counts = histogram_of(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
        gap = 0.02
    elif kind == "lognormal":
        lengths, counts = np.unique(np.clip(rng.lognormal(5, 1.2, 200_000).astype(int), 1, 1023), return_counts=True)
    elif kind == "halves":
        lengths, counts, gap = np.array([420, 500, 600]), np.array([500, 500, 1000]), 0.02
    else:
        lengths, counts, gap = np.array([300, 341, 512]), np.array([10**9, 10**9, 10**9]), 0.02
    use, bound = packing.solve(lengths, counts, 1024)
    covered = np.zeros(len(lengths))
    for config, x in use.items():
        assert x > 0 and sum(lengths[j] * a for j, a in config) <= 1024
        for j, a in config:
            covered[j] += a * x
    assert (covered >= counts * (1 - 1e-9)).all()
    assert bound * (1 - 1e-9) <= sum(use.values()) <= (1 + gap) * bound
    assert bound <= sum(t for _, t in packing.best_fit(lengths, counts, 1024)) * (1 + 1e-9)
    placed, left = packing.rounded(use, lengths, counts, 1024)
    if kind in ("tables", "lognormal"):  # the plan does come from the rounded solution
        assert sum(t for _, t in placed) > 0.2 * bound and (left >= 0).all()


def check_packed(rows, texts):
    tokenizer = json_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= sum(map(len, ids.values())) / 1024 * 1.01 + 2
    for d, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert all(n == 1024 for _, _, n in own[1:]) and own[0][1] == 0 and sum(n for _, _, n in own) == len(ids[d])
    assert set(pieces) == set(ids)


def test_packed(spark, sf_dir, documents):
    check_packed(queries.op4_pack(spark, sf_dir).collect(), documents)


def test_pack_odd(spark, odd, none):
    own = odd.where("doc_id IS NOT NULL AND doc_id <> 5")
    check_packed(packing.pack_documents(own).collect(), [(r.doc_id, r.text) for r in own.collect()])
    rows = packing.pack_documents(odd).collect()
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.pack_documents(none).count() == 0


def test_special_strings_are_the_tokenizer_s():
    from glossmill.llm.tokens import encode_json

    path = vocabulary_path("byte_bpe_50k.json")
    for t in ("a<|endoftext|>b", "plain text", "", "é\n\n  x"):
        assert encode_json(path, vocabulary_path("byte_bpe_50k.tiktoken"), t) == json_tokenizer(path).encode(t, add_special_tokens=False).ids


def test_scores(spark, sf_dir, documents):
    got = queries.op5_class_lm(spark, sf_dir).collect()
    words = {d: [*t.encode().lower().split(), None] for d, t in documents}
    counts = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    sums = [0.0, 0.0]
    for r in got:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        if r.held_out:
            sums[0] += r.base_score
            sums[1] += r.score
    assert len(got) == len(documents) and sums[1] > sums[0]


def test_class_scores_by_hand(spark, documents):
    """The score of each document, worked out token by token from the learned classes with plain
    counting, and a distribution that sums to one after every class."""
    learned, rows = {}, documents[:80]
    got = class_lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), learned=learned).collect()
    end, unknown, discount = class_lm.M_END, class_lm.M_UNKNOWN, class_lm.DISCOUNT
    table = {r["word"]: (r["n"], r["class"]) for r in learned["words"].collect()}
    texts = {d: t.encode().lower().split() for d, t in rows}
    vocabulary = sorted({w for ws in texts.values() for w in ws})
    raw, at = text_bytes(pa.array([w.decode() for w in vocabulary]))
    known = {w: table[h] for w, h in zip(vocabulary, signed(word_hashes(raw, at[:-1], at[1:])).tolist(), strict=True) if h in table}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for d in train for w in texts[d])
    assert {w: n for w, (n, _) in known.items()} == dict(counts) and len(table) == len(counts)
    classes = {d: [known[w][1] if w in known else unknown for w in ws] + [end] for d, ws in texts.items()}
    pairs = Counter((b, c) for d in train for b, c in zip([end, *classes[d]], classes[d]))
    mass, kinds, words, after = Counter(), Counter(), Counter(c for _, c in known.values()), Counter()
    for (b, c), n in pairs.items():
        mass[c] += n
        after[b] += n
        kinds[b] += 1
    words[end] = 1
    smooth = sum(n + 0.5 for n in mass.values())
    unigram = {c: (n + 0.5) / smooth for c, n in mass.items()}
    to = lambda b, c: (pairs[b, c] + max(kinds[b], 1) * unigram[c]) / (after[b] + max(kinds[b], 1))
    lost = {c: discount * words[c] / mass[c] for c in mass}  # what a class leaves to unknown words
    new = lambda b: sum(to(b, c) * lost[c] for c in mass)
    spare = {c: mass[c] * lost[c] for c in mass}
    from_unknown = {c: sum(spare[b] * to(b, c) for b in mass) / sum(spare.values()) for c in mass}
    for b in mass:
        assert sum(to(b, c) * (1 - lost[c]) for c in mass) + new(b) == pytest.approx(1)
    ends = len(train)
    for r in got:
        score, b = 0.0, end
        for w, c in zip([*texts[r.doc_id], None], classes[r.doc_id], strict=True):
            if c == unknown:
                p = sum(from_unknown[x] * lost[x] for x in mass) if b == unknown else new(b)
            else:
                n, total = (ends, ends) if w is None else (known[w][0], mass[c])
                p = (from_unknown[c] if b == unknown else to(b, c)) * (n - discount) / total
            score, b = score + log10(p), c
        assert r.score == pytest.approx(score, rel=1e-9), r.doc_id


def test_middle_words_are_exchanged(spark, monkeypatch):
    """Words beyond the head join those that stand in the same places."""
    for name, value in {"HEAD": 8, "MIDDLE": 48}.items():
        monkeypatch.setattr(class_lm, name, value)
    rng = random.Random(3)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "abcd"]
    weights = [1 / (i + 1) for i in range(12)]
    rows = [(5 * i, " ".join(rng.choices(kinds[j % 4], weights)[0] for j in range(40))) for i in range(400)]
    learned = {}
    class_lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), learned=learned).count()
    table = {r["word"]: r["class"] for r in learned["words"].collect()}
    classes = []
    for kind in kinds:
        raw, at = text_bytes(pa.array(kind))
        classes.append([table[h] for h in signed(word_hashes(raw, at[:-1], at[1:])).tolist() if h in table])
    alone = sum(c not in {x for other in classes if other is not own for x in other} for own in classes for c in own)
    assert sum(map(len, classes)) > 40 and alone >= 0.9 * sum(map(len, classes))


def test_transitions_sum_to_one():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 50, (class_lm.N_MODEL, class_lm.N_MODEL))
    m[:, -1] = m[-1] = 0
    words = np.r_[rng.integers(1, 10, class_lm.N_MODEL - 2), 1, 0]
    p = 10 ** class_lm.transitions(m, words)
    known = 1 - class_lm.DISCOUNT * words[:-1] / m[:-1, :-1].sum(0)  # of a class's mass
    assert np.allclose((p[:, :-1] * known).sum(1) + p[:, -1], 1)


def test_exchange_finds_classes():
    rng = np.random.default_rng(5)
    of = rng.integers(0, 4, 42)
    b = np.zeros((42, 42), int)
    for i in range(40):
        for j in range(40):
            b[i, j] = 50 if (of[i] + 1) % 4 == of[j] else 1
    got, m = class_lm.exchange(b, 4, 30)
    h = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    value = lambda c: h(np.array([[b[:40, :40][np.ix_(c == i, c == j)].sum() for j in range(4)] for i in range(4)], float)) - h(np.array([b[:40][c == i].sum() for i in range(4)], float)) - h(np.array([b[:, :40][:, c == i].sum() for i in range(4)], float))
    assert value(got) >= value(of[:40]) - 1e-6


def test_lm_odd(spark, odd, none):
    got = class_lm.score_documents(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[6].n_tokens == 30_001
    assert all(np.isfinite(r.score) for r in got) and class_lm.score_documents(none).count() == 0

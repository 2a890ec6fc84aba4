"""Prefix trie, quality rules and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvid.llm import fill_middle, prefix_trie, quality_rules
from corvid.storage import ship

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    mark = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0], mark(y[1], y[2])))] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own_saved + sum(saved[k] for k in kids[node])
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def talks(seed, n=90, most=9, ids=None):
    rng = random.Random(seed)
    said = [f"word{i} " * rng.randint(0, 5) for i in range(6)]
    out, kept = [], []
    for c in ids or range(n):
        if kept and rng.random() < 0.4:
            v = list(rng.choice(kept))[: rng.randint(1, most)] + [(rng.choice("ua"), rng.choice(said)) for _ in range(rng.randint(0, 3))]
        else:
            v = [(rng.choice("ua"), rng.choice(said)) for _ in range(rng.randint(1, most))]
        kept.append(v)
        out += [(c, i, r, t) for i, (r, t) in enumerate(v)]
    rng.shuffle(out)
    return out


def got_trie(spark, rows, **how):
    ship(spark)
    found = prefix_trie.trie(spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")), **how)
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"segment": 2, "per_range": 7}), (3, {"segment": 3, "per_range": 1000}), (4, {"segment": 1, "per_range": 20})])
def test_trie_equals_brute_force(spark, seed, how):
    rows = talks(seed, ids=[*range(-25, 60), 10**12, 10**12 + 7])
    assert got_trie(spark, rows, **how) == brute_trie(rows)


def test_trie_of_copies_long_and_odd_conversations(spark):
    rows = [(c, i, "u", f"same {i}") for c in range(400, 700) for i in range(3)]  # a large group of copies
    rows += [(9, i, "u", f"long {i}") for i in range(120)] + [(29, i, "u", f"long {i}") for i in range(90)]
    rows += [(49, None, None, None), (49, 1, "a", ""), (49, 1, "a", ""), (51, None, "u", "x"), (None, 1, "u", "lost")]
    rows += [(c, 0, "u", "first") for c in range(1000, 1020)]  # some lose their only turn
    assert got_trie(spark, rows, segment=8, per_range=11) == brute_trie(rows)
    assert got_trie(spark, []) == Counter()
    assert got_trie(spark, [(None, 1, "u", "x")]) == Counter()


def test_losers_carry_true_lcps():
    rng = random.Random(3)
    keys = sorted({b"".join(rng.choice([b"a", b"b"]) * 16 for _ in range(rng.randint(0, 9))) for _ in range(150)})
    for n in (1, 2, 3, 7):
        runs = [[] for _ in range(n)]
        for i in range(len(keys)):
            runs[rng.randrange(n)].append(i)
        lcps = [0] * len(keys)
        for r in runs:
            for a, b in zip(r, r[1:], strict=False):
                lcps[b] = prefix_trie.lcp_of(keys[a], keys[b])
        got = list(prefix_trie.Losers([r for r in runs if r], keys, lcps))
        assert [i for i, _ in got] == list(range(len(keys)))
        for (i, _), (j, shared) in zip(got, got[1:], strict=False):
            plain = next((k for k in range(9) if keys[i][k * 16 : k * 16 + 16] != keys[j][k * 16 : k * 16 + 16]), 9)
            assert shared == min(plain, len(keys[i]) // 16, len(keys[j]) // 16)


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    upper, lower = (sum(1 for c in text if f(c)) for f in (str.isupper, str.islower))
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_cased": upper + lower, "n_upper": upper, "n_letters": sum(c.isalpha() for c in text), "n_shouts": text.count("!"),
        "n_ends": sum(bool(re.search("[.!?…。！？][\"'”’»)]*$", x)) for x in w), "n_alphabetic": sum(any(c.isalpha() for c in x) for x in w),
        "n_doubled": sum(bool(re.search(r"([^\w.\-=])\1", x)) for x in w),
    }


def brute_em(votes, steps):
    """Plain loops over all documents."""
    n_rules = len(votes[0])
    q = [0.0 if -1 in v else 1.0 for v in votes]
    for step in range(steps + 1):
        fit = []
        for chance, (a, b) in ((q, quality_rules.ON_GOOD), ([1 - x for x in q], quality_rules.ON_BAD)):
            fit.append([(a + sum(c for c, v in zip(chance, votes) if v[j] < 0)) / (b + sum(c for c, v in zip(chance, votes) if v[j] != 0)) for j in range(n_rules)])
        share = (quality_rules.GOOD_DOCS[0] + sum(q)) / (quality_rules.GOOD_DOCS[1] + len(q))
        odds = [math.log(share) - math.log(1 - share)] * len(votes)
        for j, (g, b) in enumerate(zip(*fit)):
            bad, good = min(0.0, math.log(g) - math.log(b)), max(0.0, math.log(1 - g) - math.log(1 - b))
            odds = [o + (bad if v[j] < 0 else good if v[j] > 0 else 0.0) for o, v in zip(odds, votes)]
        q = [1 / (1 + math.exp(-o)) for o in odds]
    return q, fit, share


def rule_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 8)))
    prose = [" ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(rng.randint(7, 20))) for _ in range(120)]
    junk = [" ".join(word() + "***" for _ in range(80)) for _ in range(8)] + [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(8)]
    junk += ["\n".join([" | ".join(word() for _ in range(12))] * 6) for _ in range(5)] + [("aa bb cc " * 40).strip() for _ in range(5)]
    odd = [None, "", " \n\t", "one", "a\nb\n\nb\nb \n", "é “Oui.” ñ! ÀÉ.. x… 好。", "x" * 4000, "so it goes. " * 3000, "a b a b a b c", "\x85 \xa0   end."]
    return prose + junk + odd, len(prose), len(junk)


def test_measures_equal_brute_force(spark):
    texts, *_ = rule_texts()
    got = quality_rules.measures(spark.createDataFrame(list(enumerate(texts)), DOCS))
    for r in got.collect():
        row = r.asDict()
        assert {k: v for k, v in row.items() if k != "doc_id"} == brute_measures(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_rules_estimate_equals_plain_loops(spark):
    texts, n_prose, n_junk = rule_texts()
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], DOCS).withColumn("kept", F.lit("clash"))
    got = quality_rules.judged(docs, carry=("doc_id", "kept"), steps=7).collect()
    assert len(got) == len(texts) + 1
    chances, (on_good, on_bad), share = brute_em([tuple(r.votes) for r in got], 7)
    assert np.allclose([r.posterior for r in got], chances, atol=1e-9)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and r.posterior >= 0.5)
        if r.doc_id < n_prose:
            assert r.kept
        elif r.doc_id < n_prose + n_junk:
            assert not r.kept
    told = {r.rule: r for r in quality_rules.report(docs, steps=7).collect()}
    assert np.allclose([r.bad_on_good for r in told.values()], on_good) and np.allclose([r.bad_on_bad for r in told.values()], on_bad)


def test_rules_on_nothing(spark):
    assert quality_rules.judged(spark.createDataFrame([], DOCS)).collect() == []
    one = quality_rules.judged(spark.createDataFrame([(None, None)], DOCS)).collect()
    assert [(r.doc_id, r.n_words, r.kept) for r in one] == [(None, 0, False)]


def brute_fill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_brute_force(spark):
    ship(spark)
    rng = random.Random(8)
    letters = "aé好🙂 \n<>PSḾ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [None, "", "x", "🙂", "a <P> b", "<S>", "no <M", "好" * 70000, "é🙂" * 30000, "<" * 50]
    rows = [*enumerate(texts), (None, "lost id"), (None, None), (5, texts[5])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("output", F.lit("clash")).withColumn("extra", F.lit(1))
    got = fill_middle.transform(docs)
    assert got.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fill(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digest(fill_middle.transform(spark.createDataFrame([], DOCS))).collect() == []


def test_rank_and_select():
    rng = random.Random(2)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        raw = "".join(rng.choice("aé好🙂") for _ in range(size)).encode()
        marks = fill_middle.Boundaries(np.frombuffer(raw, np.uint8))
        starts = [i for i, x in enumerate(raw) if x & 0xC0 != 0x80]
        assert marks.rank(np.arange(len(raw) + 1)).tolist() == [sum(1 for s in starts if s < i) for i in range(len(raw) + 1)][: len(raw) + 1] if len(raw) < 3000 else True
        assert marks.select(np.arange(len(starts) + 1)).tolist() == [*starts, len(raw)]


def test_cut_reads_slices_of_a_batch(monkeypatch):
    monkeypatch.setattr(fill_middle, "SPAN", 10)
    texts = ["", "aé好", "x" * 30, "🙂🙂", "", "end"]
    arr = pa.array(["skipped", *texts])[1:]
    h = np.arange(6, dtype=np.int64) * 7 + 1
    n, sizes, parts = fill_middle.cut(arr, h, h * 3)
    assert n.tolist() == [len(t) for t in texts]
    for t, (a, m), p, x in zip(texts, sizes, parts, h, strict=True):
        lo, hi = sorted((int(x) % (len(t) + 1), int(x * 3) % (len(t) + 1)))
        assert ((a, m), [y.decode() for y in p]) == ((lo, hi - lo), [t[:lo], t[lo:hi], t[hi:]])

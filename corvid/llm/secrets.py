"""Secret scans: patterns, and a character convolutional network over every candidate.

Three patterns give base findings, which always stay: assignments, access keys and
long hexadecimal runs.  Candidates are those findings and every other run of eight or
more key characters that holds a digit, mixes cases inside (sixteen or more), or stands
behind a mark of assignment or a word for keys.  A small convolutional network in numpy
reads each candidate with the characters around it, a long one in overlapping windows of
which the best counts; candidates over its threshold that overlap no base finding are
added with kind ``model``.

The network is trained on the driver from two sets of labelled findings: those of the
documents themselves (base findings as secrets, read from their values on, so that the word
that names them stands before the window's body as it does for any other candidate; numbers,
dates and the like as none; what is neither is not known and trains nothing; at most
MAX_WINDOWS, by the order of a hash) and findings made by rule (keys of many forms in code
and configuration, against e-mail parts, links, numbers, identifiers, dates and words)
between pieces of those documents.  A quarter of the documents, and of the made findings, is
held out: on it the score is calibrated by Platt's sigmoid, and the threshold is the
highest one whose recall there reaches ``RECALL``.  ``quality`` gives both figures.

Edge cases: null and empty texts have no findings; equal spans of different kinds are
listed in the order of KINDS; repeated rows give equal findings; offsets count code
points of the whole text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.storage import durable

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: What stands before a candidate that has no digit and no mixed case.
_LEAD = re.compile(r"""(?:[:=]\x20?["']?|(?:bearer|basic|auth|key|pass|secret|token|credential)\W{1,3})$""", re.I | re.A)
#: RE2 forms that let whole texts pass by quickly; each finds at least what its pattern finds.
_ANY_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]"
_ANY_OTHER = r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{16}|[0-9:=]|(?i:bearer|basic|auth|key|pass|secret|token|credential)"
LEFT, BODY, RIGHT = 24, 40, 8
WIDTH = LEFT + BODY + RIGHT
#: Candidates of the documents that are no secrets for certain: numbers of cards, telephones and accounts, dates, versions.
_HARMLESS = re.compile(r"[0-9=+/_-]+|(?:[0-9]{1,4}[-/_])+[A-Za-z]{3,9}(?:[-/_][0-9]{1,4})*")
_PART = re.compile(r"(?<=[/=+])[A-Za-z0-9_-]{16,}")
#: Least recall of the threshold on the held-out findings.
RECALL = 0.98
N_FINDINGS = 3000
#: Windows of labelled findings taken from the documents, and characters of text taken with each.
MAX_WINDOWS, AROUND = 6000, 60
FILTERS, KERNEL, EPOCHS, SEED = 12, 4, 8, 11


def _symbols() -> np.ndarray:
    """Code point to symbol: letters by case and vowel or hexadecimal use, digits, marks one by one, the rest."""
    table = np.full(128, 1, np.uint8)
    groups = ["aeiou", "bcdf", "ghjklmnpqrstvwxyz", "AEIOU", "BCDF", "GHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n\r\t", "=", ":", "\"'", "+/", "_", "-", ".,;", "@", "<>()[]{}"]
    for i, g in enumerate(groups):
        table[[ord(c) for c in g]] = i + 2
    return table


_TABLE = _symbols()
N_SYMBOLS = int(_TABLE.max()) + 1


def starts(text: str, start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin: every half BODY up to its end, and at each long enough part after a joint."""
    at = {start, *range(start, end - BODY, BODY // 2)}
    if end - start > BODY:
        at |= {end - BODY, *(m.start() for m in _PART.finditer(text, start, end))}
    return sorted(at)


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of a candidate (BODY characters from ``start``) between LEFT characters before and RIGHT after; 0 pads."""
    out = np.zeros(WIDTH, np.uint8)
    for at, part in ((LEFT - min(LEFT, start), text[max(0, start - LEFT) : start]), (LEFT, text[start : min(end, start + BODY)]), (LEFT + BODY, text[end : end + RIGHT])):
        code = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        out[at : at + len(code)] = np.where(code < 128, _TABLE[np.minimum(code, 127)], 1)
    return out


class Network:
    """One convolution, rectified and max-pooled over the three parts, then a logistic layer and a calibration."""

    def __init__(self, rng: np.random.Generator):
        self.conv = rng.normal(0, 0.25, (KERNEL, N_SYMBOLS, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.2, 3 * FILTERS)
        self.off = np.zeros(1)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.held_out: tuple = ()
        n = WIDTH - KERNEL + 1
        self.parts = [slice(0, LEFT), slice(LEFT, LEFT + BODY), slice(LEFT + BODY - KERNEL, n)]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        n = WIDTH - KERNEL + 1
        return np.maximum(0, sum(self.conv[j][x[:, j : j + n]] for j in range(KERNEL)) + self.bias)

    def pooled(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([h[:, p].max(1) for p in self.parts[:1]] + [h[:, self.parts[1]].mean(1) * 3] + [h[:, self.parts[2]].max(1)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(self.hidden(x[i : i + 1024])) @ self.out + self.off for i in range(0, len(x), 1024)] or [np.empty(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logit(x) + self.shift).clip(-30, 30)))

    def best(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """The highest score of each span's windows."""
        at = [starts(text, s, e) for s, e in spans]
        all_windows = [(a, e) for own, (_, e) in zip(at, spans, strict=True) for a in own]
        score = np.concatenate([self.score(np.array([window(text, a, e) for a, e in all_windows[i : i + 4096]])) for i in range(0, len(all_windows), 4096)])
        return np.maximum.reduceat(score, np.cumsum([0, *map(len, at[:-1])]))

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        params = [self.conv, self.bias, self.out, self.off]
        m, v, step, n = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, WIDTH - KERNEL + 1
        for _ in range(EPOCHS):
            for idx in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                xb, step = x[idx], step + 1
                h = self.hidden(xb)
                z = self.pooled(h)
                g = (1 / (1 + np.exp(-(z @ self.out + self.off).clip(-30, 30))) - y[idx]) / len(idx)
                dz = np.outer(g, self.out)
                dh = np.zeros_like(h)
                rows, cols = np.arange(len(idx))[:, None], np.arange(FILTERS)[None]
                for part, k in ((0, 0), (2, 2)):
                    sl = self.parts[part]
                    dh[rows, h[:, sl].argmax(1) + sl.start, cols] += dz[:, k * FILTERS : (k + 1) * FILTERS]
                mid = self.parts[1]
                dh[:, mid] += dz[:, None, FILTERS : 2 * FILTERS] * (3 / (mid.stop - mid.start))
                dh *= h > 0
                dconv = np.zeros_like(self.conv)
                for j in range(KERNEL):
                    hot = np.eye(N_SYMBOLS)[xb[:, j : j + n].ravel()]
                    dconv[j] = hot.T @ dh.reshape(-1, FILTERS)
                for i, q in enumerate((dconv, dh.sum((0, 1)), z.T @ g, np.array([g.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * q
                    v[i] = 0.999 * v[i] + 0.001 * q * q
                    params[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logit(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b).clip(-30, 30)))
            a, b = a - 0.05 * ((p - y) * z).mean(), b - 0.2 * (p - y).mean()
        self.slope, self.shift = a, b
        ranked = np.sort(self.score(x)[y == 1])
        self.threshold = float(ranked[int((1 - RECALL) * len(ranked))])


def made_findings(n: int = N_FINDINGS, seed: int = SEED, around: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of findings made by rule, half of them secrets, between pieces of text ``around``."""
    rng = np.random.default_rng(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def draw(chars: str, k: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), k))

    def word() -> str:
        syllables = ["the", "an", "on", "er", "ing", "ti", "on", "re", "le", "ment", "que", "en", "sch", "un", "ado", "ci", "os", "ra"]
        return "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 5)))

    def key() -> str:
        kind = rng.integers(0, 7)
        k = int(rng.integers(20, 64))
        return [
            draw(dig + "abcdef", max(k, 20)), draw(low + up + dig, k), draw(low + up + dig + "+/", k) + "=" * int(rng.integers(0, 3)),
            ["sk_live_", "ghp_", "xoxb-", "AIza"][rng.integers(0, 4)] + draw(low + up + dig, k), draw(up + dig, k),
            draw(low + up + dig, int(rng.integers(10, 20))), draw(low, k // 2 + 8),
        ][kind]

    def plain() -> str:
        kind = rng.integers(0, 11)
        return [
            "-".join(word() for _ in range(6)) + draw(dig, 2),
            "/".join([word(), draw(dig, 4), draw(dig, 2), word(), word(), word()]),
            "_".join(word() for _ in range(5)) + "_" + draw(dig, 1),
            draw(dig, 16) + "-" + draw(dig, 6) + word(),
            "".join(word().title() for _ in range(5)) + draw(dig, 2),
            word() + word() + word() + word() + "20" + draw(dig, 2),
            "=" * 12 + word() + "-" * 10 + draw(dig, 1),
            draw(dig, int(rng.integers(8, 20))),
            "20" + draw(dig, 2) + "-" + draw(dig, 2) + "-" + draw(dig, 2),
            draw(dig, 3) + "-" + draw(dig, 4) + "-" + draw(dig, 2),
            word() + word() + word() + "er",
        ][kind]

    before = ["token = \"", "key: ", "Authorization: Bearer ", "export SECRET=", "client_secret='", "auth=", "credential: \"", "private_key = "]
    calm = [" see ", " the page ", "href=\"/", " version ", " item ", "\n", " file ", " of "]
    xs, ys = [], []
    for i in range(n):
        y = i % 2
        piece = around[rng.integers(0, len(around))] if around and rng.random() < 0.7 else " ".join(word() for _ in range(6))
        cut = len(piece) // 2
        body = key() if y else plain()
        named = (rng.random() < 0.8) == bool(y) or len(body) < 20 and y  # a short key is one only by what names it
        lead = piece[:cut] + (before if named else calm)[rng.integers(0, 8)]
        text = lead + body + ["\"", " ", "\n", "'", ";"][rng.integers(0, 5)] + " " + piece[cut:]
        xs.append(window(text, len(lead), len(lead) + len(body)))
        ys.append(y)
    return np.array(xs), np.array(ys)


def value_start(text: str, kind: str, start: int) -> int:
    """Where the value of a base finding begins."""
    return ASSIGN.match(text, start).start(2) if kind == "assign" else start


def labelled(text: str) -> list[tuple[int, int, int]]:
    """label, start, end of the candidates of a text whose label is known."""
    base = base_findings(text)
    known = [(1, value_start(text, k, s), e) for k, s, e in base]
    return known + [(0, s, e) for s, e in other_candidates(text, base) if _HARMLESS.fullmatch(text, s, e)]


def table_findings(docs: DataFrame, most: int = MAX_WINDOWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and folds (0 to 3, by document) of findings of the documents (doc_id, text), and the texts around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for fold, text in _texts(b, b.column("fold").to_pylist()):
                for label, s, e in labelled(text):
                    piece = text[max(0, s - AROUND) : s] + text[e : e + AROUND]
                    for c, v in zip(out, (fold, label, window(text, s, e).tobytes(), piece), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("fold", "label", "window", "piece"), out, (pa.int64(), pa.int32(), pa.binary(), pa.string()), strict=True)})

    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("secrets")), F.lit(4))
    found = docs.select(fold.alias("fold"), "text").mapInArrow(run, "fold long, label int, window binary, piece string")
    # equal numbers of both labels at most, repeats once: a bounded sample of labelled findings, from one scan of the texts
    mark = F.xxhash64("window", F.lit(SEED))
    once = durable(found.groupBy("window", "label").agg(F.min("fold").alias("fold"), F.min("piece").alias("piece")), "secrets-labelled")
    rows = [r for y in (0, 1) for r in once.where(F.col("label") == y).orderBy(mark, "window").limit(most // 2).collect()]
    x = np.array([np.frombuffer(r["window"], np.uint8) for r in rows], np.uint8).reshape(-1, WIDTH)
    return x, np.array([r["label"] for r in rows], np.int64), np.array([r["fold"] for r in rows], np.int64), [r["piece"] for r in rows if r["fold"] > 0]


def train(docs: DataFrame | None = None, n: int = N_FINDINGS, seed: int = SEED) -> Network:
    """A network fitted on three quarters of the labelled findings and calibrated on the rest; ``held_out`` (windows, labels,
    which are of the documents) are kept with it."""
    around: list[str] = []
    x, y, fold = np.empty((0, WIDTH), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    if docs is not None:
        x, y, fold, around = table_findings(docs)
    made_x, made_y = made_findings(n, seed, around)
    made_fold = np.arange(n) // 2 % 4
    both_x, both_y, out = np.concatenate([x, made_x]), np.concatenate([y, made_y]), np.concatenate([fold, made_fold]) == 0
    rng = np.random.default_rng(seed)
    net = Network(rng)
    net.fit(both_x[~out], both_y[~out], rng)
    net.calibrate(both_x[out], both_y[out])
    net.held_out = both_x[out], both_y[out], (np.arange(len(both_y)) < len(y))[out]
    return net


def quality(net: Network) -> dict[str, float]:
    """Recall and precision at the threshold on the held-out findings: all of them, and those of the documents."""
    x, y, own = net.held_out
    hit = net.score(x) >= net.threshold
    out = {}
    for name, part in (("all", np.ones(len(y), bool)), ("documents", own)):
        right = (hit & (y == 1) & part).sum()
        out |= {f"recall_{name}": float(right / max(1, ((y == 1) & part).sum())), f"precision_{name}": float(right / max(1, (hit & part).sum())), f"n_{name}": int(part.sum())}
    return out


def _texts(b: pa.RecordBatch, keys: list) -> Iterator[tuple]:
    """key, text of the rows whose text may hold a finding or candidate."""
    column = pc.fill_null(b.column("text"), "")
    maybe = pc.or_(pc.match_substring_regex(column, _ANY_ASSIGN), pc.match_substring_regex(column, _ANY_OTHER)).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(maybe):
        yield keys[i], column[int(i)].as_py()


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the pattern findings, by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _is_candidate(text: str, m: re.Match) -> bool:
    run = m[0]
    if any(c.isdigit() for c in run):
        return True
    tail = run[1:]
    if len(run) >= 16 and tail.upper() != tail and tail.lower() != tail:
        return True
    return _LEAD.search(text[max(0, m.start() - 16) : m.start()]) is not None and any(c.isalpha() for c in run)


def other_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans of the other candidates: those that overlap no base finding."""
    covered, out, i, reach = sorted((s, e) for _, s, e in base), [], 0, -1
    for m in CANDIDATE.finditer(text):
        # the furthest end of the findings that begin before this run ends
        while i < len(covered) and covered[i][0] < m.end():
            reach = max(reach, covered[i][1])
            i += 1
        if reach <= m.start() and _is_candidate(text, m):
            out.append(m.span())
    return out


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None) -> DataFrame:
    """doc_id and findings (array of kind, start, end, score) of every document: all base ones and the network's."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    net = docs.sparkSession.sparkContext.broadcast(network or train(slim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for b in batches:
            per_doc: list[list[tuple]] = [[] for _ in range(b.num_rows)]
            for i, text in _texts(b, list(range(b.num_rows))):
                base = base_findings(text)
                spans = [*base, *(("model", *s) for s in other_candidates(text, base))]
                if spans:
                    score = model.best(text, [(value_start(text, k, s), e) for k, s, e in spans])
                    kept = [(k, s, e, float(p)) for (k, s, e), p in zip(spans, score, strict=True) if k != "model" or p >= model.threshold]
                    per_doc[i] = sorted(kept, key=lambda f: (f[1], KINDS.index(f[0])))
            rows = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in doc] for doc in per_doc]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "findings": pa.array(rows, kind)})

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, findings array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of ``findings``' rows."""

    def n(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = joined(F.filter("findings", lambda f: f["kind"] != "model"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def brute_sha256(text: str | None) -> str:
    """The base digest of one text, straight from the rule."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_findings(text or "")).encode()).hexdigest()

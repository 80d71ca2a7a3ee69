"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field's sequences are the runs of non-blank characters (chunks) that hold a candidate token, that is one with a digit or of
20 characters and more; tokens are runs of [A-Za-z0-9_+/-] or single other characters. Tags: O outside, B begin, I inside of a
secret. B is only for candidates, I only follows B or I, so a chunk without a candidate is O throughout, whatever the weights:
leaving such chunks out changes nothing. A token's features are its shape, its neighbours, the words before and after the chunk,
and features of the file; tags are decoded by Viterbi. The field is trained by forward-backward on the patterns' own matches in
a bounded sample of documents and on made-up lines of other secret formats, credentials and harmless look-alikes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import plain, text_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
_CUES = ("passw", "secret", "token", "api")
_KEY = re.compile(r"pass(wd|word)?$|pwd$|secret$|token$|key$|auth$|bearer$|credential", re.I | re.A)
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]+|[^A-Za-z0-9_+/-]")
_PARTS = re.compile(r"[_+/-]")
_KNOWN = re.compile(r"AKIA|ASIA|gh[pousr]_|sk_|pk_|xox[abp]|eyJ|glpat|AIza")


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_IS_DIGIT, _IS_HEX, _IS_SPACE = _lut(_DIGITS), _lut(_DIGITS + "abcdef"), _lut(" \t\n\r\v\f")
_IS_WORD = _lut(_DIGITS + _LETTERS + _LETTERS.upper() + "_+/-")

# ---- features ---------------------------------------------------------------------------------------------------------------

_SHAPES = ("lower", "title", "upper", "letters", "digits", "hex", "lower+digit", "upper+digit", "mixed+digit", "joined", "symbol")
_LENGTHS = (2, 4, 8, 12, 16, 20, 32, 64)
_BEFORE = ("none", "key", "plain", "digit", "symbol")
NAMES = [*(f"shape={s}" for s in _SHAPES), *(f"length<{n}" for n in (*_LENGTHS, "more")), *(f"turns={n}" for n in ("0", "1", "2-3", "4-7", "8+")), "known prefix", "few kinds of characters", "part of 16 or more", "part mixes letters and digits", "part mixes cases", "key before in chunk", "key just before chunk", "key two words before", "after =", "after :", "after quote", "after dot", "after @", "before quote", "before dot", "before @", "first in chunk", "last in chunk", "dots or @ in chunk", "word before has digit", "word after has digit", "file has keys", "file has code marks", "file is short", "bias"]
_AT = {n: i for i, n in enumerate(NAMES)}


def candidate(token: str) -> bool:
    return len(token) >= 20 and token[0].isascii() and (token[0].isalnum() or token[0] in "_+/-") or any(c in _DIGITS for c in token)


def _own(t: str) -> list[int]:
    if len(t) == 1 and not (t.isascii() and t.isalnum()):
        shape = "symbol"
    elif any(c in "_+/-" for c in t):
        shape = "joined"
    elif t.isalpha():
        shape = "lower" if t.islower() else "upper" if t.isupper() else "title" if t.istitle() else "letters"
    elif t.isdigit():
        shape = "digits"
    elif all(c in "0123456789abcdef" for c in t):
        shape = "hex"
    else:
        lo, up = any(c.islower() for c in t), any(c.isupper() for c in t)
        shape = "mixed+digit" if lo and up else "upper+digit" if up else "lower+digit"
    length = next((n for n in _LENGTHS if len(t) < n), "more")
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 for c in t]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    turn = "0" if not turns else "1" if turns == 1 else "2-3" if turns < 4 else "4-7" if turns < 8 else "8+"
    out = [_AT[f"shape={shape}"], _AT[f"length<{length}"], _AT[f"turns={turn}"], _AT["bias"]]
    if _KNOWN.match(t):
        out.append(_AT["known prefix"])
    part = max(_PARTS.split(t), key=len)
    if len(part) >= 16:
        out.append(_AT["part of 16 or more"])
    if len(part) >= 8 and any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
        out.append(_AT["part mixes letters and digits"])
    if len(part) >= 8 and any(c.islower() for c in part) and any(c.isupper() for c in part[1:]):
        out.append(_AT["part mixes cases"])
    if len(t) >= 12 and len(set(t)) * 3 <= len(t):
        out.append(_AT["few kinds of characters"])
    return out


def features(tokens: list[str], before: list[str], after: list[str], file: tuple[str, ...]) -> np.ndarray:
    """Tokens x features, of one chunk; before and after: the words around it; file: names of file features."""
    x = np.zeros((len(tokens), len(NAMES)))
    common = [_AT[f] for f in file]
    strip = [w.strip("\"'=:,;(){}[]").lower() for w in before[-2:]]
    if strip and _KEY.search(strip[-1]):
        common.append(_AT["key just before chunk"])
    if len(strip) > 1 and _KEY.search(strip[-2]):
        common.append(_AT["key two words before"])
    if before and any(c in _DIGITS for c in before[-1]):
        common.append(_AT["word before has digit"])
    if after and any(c in _DIGITS for c in after[0]):
        common.append(_AT["word after has digit"])
    if "@" in tokens or tokens.count(".") > 1:
        common.append(_AT["dots or @ in chunk"])
    key = False
    marks = {"=": "=", ":": ":", '"': "quote", "'": "quote", ".": "dot", "@": "@"}
    tail = before[-1][-1:] if before else ""
    for i, t in enumerate(tokens):
        on = _own(t) + common
        prev, nxt = tokens[i - 1] if i else tail, tokens[i + 1] if i + 1 < len(tokens) else ""
        if key:
            on.append(_AT["key before in chunk"])
        if prev in marks:
            on.append(_AT["after " + marks[prev]])
        if nxt in marks and marks[nxt] in ("quote", "dot", "@"):
            on.append(_AT["before " + marks[nxt]])
        if not i:
            on.append(_AT["first in chunk"])
        if i + 1 == len(tokens):
            on.append(_AT["last in chunk"])
        x[i, on] = 1
        key = key or bool(_KEY.search(t))
    return x


# ---- the field --------------------------------------------------------------------------------------------------------------

O, B, I = 0, 1, 2
_STEP = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], dtype=bool)  # I only after B or I


@dataclass
class Field:
    emit: np.ndarray  # features x 3
    move: np.ndarray  # 3 x 3

    def viterbi(self, x: np.ndarray, may_begin: np.ndarray) -> list[int]:
        e = x @ self.emit
        e[~may_begin, B] = -np.inf
        move = np.where(_STEP, self.move, -np.inf)
        s, back = e[0].copy(), []
        s[I] = -np.inf
        for t in range(1, len(e)):
            via = s[:, None] + move
            back.append(via.argmax(axis=0))
            s = via.max(axis=0) + e[t]
        tags = [int(s.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train_field(xs: list[np.ndarray], begins: list[np.ndarray], tags: list[list[int]], steps: int = 150, pull: float = 0.02) -> Field:
    """Maximum likelihood by forward-backward over padded sequences, with Adam."""
    n, most, k = len(xs), max(map(len, xs)), len(NAMES)
    x, mask, gold, may = np.zeros((n, most, k)), np.zeros((n, most), bool), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (a, b, t) in enumerate(zip(xs, begins, tags, strict=True)):
        x[i, : len(a)], mask[i, : len(a)], gold[i, : len(a)], may[i, : len(a)] = a, True, t, b
    emit, move, far = np.zeros((k, 3)), np.zeros((3, 3)), -1e9
    hot = np.eye(3)[gold] * mask[..., None]
    pairs = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    want = np.einsum("ntk,nta->ka", x, hot)
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, steps + 1):
        e = x @ emit
        e[..., B] = np.where(may, e[..., B], far)
        m = np.where(_STEP, move, far)
        alpha, beta = np.zeros((n, most, 3)), np.zeros((n, most, 3))
        alpha[:, 0] = e[:, 0]
        alpha[:, 0, I] = far
        for t in range(1, most):
            alpha[:, t] = np.where(mask[:, t, None], _logsum(alpha[:, t - 1, :, None] + m, 1) + e[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _logsum(m + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        z = _logsum(alpha[:, -1], 1)
        node = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[..., None]
        edge = np.exp(np.minimum(alpha[:, :-1, :, None] + m + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * mask[:, 1:, None, None]
        grads = ((np.einsum("ntk,nta->ka", x, node) - want) / n + pull / n * emit, (edge.sum(axis=(0, 1)) - pairs) / n + pull / n * move)
        for i, (p, g) in enumerate(zip((emit, move), grads, strict=True)):
            a, b = moments[2 * i], moments[2 * i + 1]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(emit, move)


# ---- scanning ---------------------------------------------------------------------------------------------------------------


def _long_runs(is_in: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_in, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def base_spans(text: str, hexes: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start of the value, its end), by start and kind; leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hexes is None:
        hexes = [m.span() for m in re.finditer(r"[0-9a-f]{16,}", text)]  # runs are maximal, so shorter ones fail as a whole
    return sorted(out + [(a, 2, b, a, b) for a, b in hexes])


def _file_features(text: str) -> tuple[str, ...]:
    low = text.lower()
    return (*(["file has keys"] if any(c in low for c in _CUES) else []), *(["file has code marks"] if 50 * (text.count("=") + text.count("{") + text.count(";")) > len(text) else []), *(["file is short"] if len(text) < 200 else []))


def chunks(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, list[str], list[str], list[str]]]]]:
    """For each text with any: (its index, spans of long hex runs, [(start, tokens, words before, words after)] of chunks with a candidate). Offsets count code points."""
    raws = [t.encode() for t in texts]
    raw = b"\n".join([*raws, b""])
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return
    firsts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    hex_start, hex_end = _long_runs(_IS_HEX[b], 16)
    run_start, run_end = _long_runs(_IS_WORD[b], 20)
    spots = np.unique(np.concatenate([np.flatnonzero(_IS_DIGIT[b]), run_start]))
    space = np.flatnonzero(_IS_SPACE[b])
    nth = np.unique(np.searchsorted(space, spots))  # the blank that ends the chunk
    ends = space[nth]
    starts = np.where(nth > 0, space[nth - 1] + 1, 0)
    owner, hex_owner = np.searchsorted(firsts, starts, side="right") - 1, np.searchsorted(firsts, hex_start, side="right") - 1
    at, hx = 0, 0
    for i in sorted({*owner.tolist(), *hex_owner.tolist()}):
        base, ascii_ = int(firsts[i]), len(raws[i]) == len(texts[i])
        chars = None if ascii_ else np.concatenate([[0], np.cumsum((b[base : base + len(raws[i])] & 0xC0) != 0x80)])
        place = (lambda p: int(p)) if ascii_ else (lambda p, c=chars: int(c[p]))
        hexes, found = [], []
        while hx < len(hex_owner) and hex_owner[hx] == i:
            hexes.append((place(hex_start[hx] - base), place(hex_end[hx] - base)))
            hx += 1
        stop = base + len(raws[i])
        while at < len(owner) and owner[at] == i:
            s, e = int(starts[at]), int(ends[at])
            before = raw[max(base, s - 80) : s].decode(errors="ignore").split()[-2:]
            after = raw[e : min(stop, e + 40)].decode(errors="ignore").split()[:1]
            found.append((place(s - base), _TOKEN.findall(raw[s:e].decode()), before, after))
            at += 1
        yield i, hexes, found


def scan(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int, int, int]]]:
    """All spans of each text: those of base_spans, then the field's that no base span contains."""
    seen = {i: (h, c) for i, h, c in chunks(texts)}
    out = []
    for i, text in enumerate(texts):
        hexes, found = seen.get(i, ([], []))
        spans = base_spans(text, hexes)
        if field is not None and found:
            file, base = _file_features(text), [(s[0], s[2]) for s in spans]
            for start, tokens, before, after in found:
                tags = field.viterbi(features(tokens, before, after, file), np.array([candidate(t) for t in tokens]))
                ends = np.cumsum([0, *map(len, tokens)]) + start
                for j, tag in enumerate(tags):
                    if tag == B:
                        k = j + 1
                        while k < len(tags) and tags[k] == I:
                            k += 1
                        a, z = int(ends[j]), int(ends[k])
                        if not any(p <= a and z <= q for p, q in base):
                            spans.append((a, 3, z, a, z))
        out.append(sorted(spans))
    return out


def mask(text: str, spans: list[tuple[int, int, int, int, int]], put: str = "[SECRET]") -> str:
    """The text with each secret value, overlaps joined, replaced."""
    out, at = [], 0
    for _, _, _, a, z in sorted(spans, key=lambda s: (s[3], -s[4])):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, z)
    return "".join([*out, text[at:]])


# ---- training ---------------------------------------------------------------------------------------------------------------


def made_up(n: int = 1500, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines by rule: (text, spans of secrets). Other secret formats among plain words, and numbers and names that are no secrets."""
    rng = np.random.default_rng(seed)
    alnum, vowels = _DIGITS + _LETTERS + _LETTERS.upper(), "aeiou"
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    word = lambda: "".join(pick(_LETTERS, 1) + pick(vowels, 1) for _ in range(rng.integers(1, 5)))
    number = lambda k: pick(_DIGITS, k)
    secret = [lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + number(11) + "-" + pick(alnum, 24), lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 30), lambda: pick(alnum, int(rng.integers(20, 44))), lambda: "AIza" + pick(alnum + "_-", 35), lambda: pick("abcdef" + _DIGITS, 40), lambda: "AKIA" + pick(alnum[:10] + alnum[36:], 16)]
    plain = [lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", lambda: ".".join(number(int(rng.integers(1, 4))) for _ in range(4)), lambda: f"{word()}.{number(2)}@{word()}{number(1)}.example.com", lambda: number(int(rng.integers(1, 9))), lambda: f"https://{word()}.example.org/{word()}/{number(5)}", lambda: f"v{number(1)}.{number(2)}.{number(1)}", lambda: word() + number(int(rng.integers(1, 4))), lambda: f"{number(2)}:{number(2)}", lambda: word() + "-" + word() + "-" + word() + "-" + word() + "-" + word(), lambda: "".join(word() for _ in range(4)), lambda: f"${number(3)},{number(3)}.{number(2)}", lambda: word().upper() + number(3)]
    lead = [lambda: "", lambda: "key=", lambda: "password: ", lambda: "token = ", lambda: "auth: Bearer ", lambda: "secret=", lambda: "api_key: "]
    out = []
    for i in range(n):
        is_secret = i % 3 == 0
        quote = pick("\"'", 1) if rng.random() < 0.3 else ""
        value = (secret[rng.integers(0, len(secret))] if is_secret else plain[rng.integers(0, len(plain))])()
        head = " ".join(word() for _ in range(rng.integers(0, 5)))
        text = f"{head} {lead[rng.integers(0, len(lead))]() if is_secret or rng.random() < 0.05 else ''}{quote if is_secret else ''}"
        at = len(text)
        text += value + (quote if is_secret else "") + (pick(".,;", 1) if rng.random() < 0.2 else "") + " " + " ".join(word() for _ in range(rng.integers(0, 4)))
        out.append((text, [(at, at + len(value))] if is_secret else []))
    return out


def fit(docs: DataFrame, most: int = 1200, longest: int = 40) -> Field:
    """Train the field on at most `most` documents (those with the least hash of doc_id) and the made-up lines.

    Chunks of more than `longest` tokens are left out of training only.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = docs.sparkSession.createDataFrame([(r[0],) for r in ids.collect()], "doc_id long")
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(chosen), "doc_id").where("text is not null").toArrow().to_pylist()
    lines = [(r["text"], [(s[3], s[4]) for s in base_spans(r["text"])]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))] + made_up()
    xs, begins, tags = [], [], []
    for i, _, found in chunks([t for t, _ in lines]):
        text, spans = lines[i]
        file = _file_features(text)
        for start, tokens, before, after in found:
            if len(tokens) > longest:
                continue
            may, tag, at, inside = [candidate(t) for t in tokens], [], start, False
            for t, m in zip(tokens, may, strict=True):
                hit = any(a <= at < z for a, z in spans)
                tag.append(I if hit and inside else B if hit and m else O)
                inside = tag[-1] != O
                at += len(t)
            xs.append(features(tokens, before, after, file)), begins.append(np.array(may)), tags.append(tag)
    return train_field(xs, begins, tags)


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>, masked string"
DIGESTS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan_secrets(docs: DataFrame, field: Field | None, digests: bool = False) -> DataFrame:
    """Scan every text whole. Returns doc_id, spans (kind, start, end in code points), masked text; or counts and digests.

    One row per input row, repeats too. Null texts count as empty: no spans, masked text null. A null doc_id stays null. Spans
    are ordered by start, then kind (assign, access, hex, crf); kinds may overlap each other. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                doc, found = batch.column(0).slice(a, b - a), scan(texts, field)
                if digests:
                    text = [[",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in f if s[1] < k) for f in found] for k in (3, 4)]
                    cols = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(4)]
                    yield pa.RecordBatch.from_arrays([doc, *cols[:3], pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text[0]]), pa.array(text[1], pa.string()), cols[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])
                else:
                    nulls = batch.column(1).slice(a, b - a).is_null().to_pylist()
                    spans = pa.array([[{"kind": KINDS[s[1]], "start": s[0], "end": s[2]} for s in f] for f in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([doc, spans, pa.array([None if n else mask(t, f) for t, f, n in zip(texts, found, nulls, strict=True)], pa.string())], names=["doc_id", "spans", "masked"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, DIGESTS if digests else SPANS)


def mask_secrets(docs: DataFrame, field: Field | None) -> DataFrame:
    """The same rows and columns, whatever their names, with the secrets in `text` replaced; n_chars, where there is one, counts the new text."""
    docs, before = plain(docs, {"text", "n_chars"})
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for a, b, texts in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                nulls = part.column(k).is_null().to_pylist()
                new = [None if n else mask(t, s) if s else t for t, s, n in zip(texts, scan(texts, field), nulls, strict=True)]
                cols = list(part.columns)
                cols[k] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, docs.schema)
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
    return out.toDF(*before)

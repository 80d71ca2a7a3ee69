"""Byte-level BPE with the tokenizers library: chunk-cached encoding, and decoding by the byte table.

A text is cut at single spaces that stand between two non-blank characters. The split pattern of byte-level BPE starts a
new piece at each such space, whatever stands around it, so the ids of the chunks, joined, are the ids of the text. Chunks
repeat a lot, so each worker keeps a bounded cache of them; a chunk that isn't in it is encoded with the others of its batch.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import held, text_slices

#: Chunks kept in a worker's cache, and the longest chunk that is kept. Bounds memory only; ids don't depend on them.
CACHE_CHUNKS = 600_000
CACHE_CHARS = 48
#: Chunks that are encoded as lines of one string.
LINES = 24
_RUN = re.compile(r"\s\s|\s\Z")
_EDGE = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_chars() -> dict[int, str]:
    """The usual byte-to-character table: printable Latin-1 bytes stand for themselves, the others for 256 and on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers.Tokenizer that merges as the ranks say: every split of a token into two tokens merges at the token's rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    shown = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE(vocab={shown[t]: i for t, i in ranks.items()}, merges=merges, cache_capacity=0))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. `encode_batch` gives the ids of each string of a list."""

    def __init__(self, encode_batch: Callable[[list[str]], list[list[int]]], most: int = CACHE_CHUNKS, special: tuple[str, ...] = ()):
        self.encode_batch, self.most, self.special = encode_batch, most, special
        (self.newline,) = encode_batch(["\n"])[0]
        self.cache: dict[str, bytes] = {}  # a chunk, without the space before it

    def _ids(self, strings: list[str]) -> list[bytes]:
        return [np.asarray(i, dtype="<u4").tobytes() for i in self.encode_batch(strings)] if strings else []

    def _chunk_ids(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of " " + chunk. Many chunks are encoded as lines of one string: a newline with no other blank beside it, or with a space after it, is a piece of its own."""
        alone, lines = [], []
        plain = not _RUN.search(" ".join(chunks)) and not any(y in x for x in ["".join(chunks)] for y in self.special)
        if plain:
            lines = chunks
        for x in [] if plain else chunks:
            (alone if _RUN.search(x) or any(s in x for s in self.special) else lines).append(x)
        out = dict(zip(alone, self._ids([" " + x for x in alone]), strict=True))
        parts = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
        for part, ids in zip(parts, self._ids(["".join([" " + x + "\n" for x in p]) for p in parts]), strict=True):
            ids = np.frombuffer(ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.newline).tolist()
            raw, at, n = ids.tobytes(), 0, -1
            for x in part:
                n += 1 + x.count("\n")
                out[x] = raw[4 * at : 4 * ends[n]]
                at = ends[n] + 1
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        get, rows, missing, heads = self.cache.get, [], [], set()
        for t in texts:
            head, *rest = t.split(" ")
            found = list(map(get, rest))
            gaps = [i for i, x in enumerate(found) if x is None] if None in found else []
            if gaps or rest and (not head or head[-1].isspace()):
                # a blank at a chunk's end, or an empty chunk, means a run of blanks: cut between non-blank characters only
                if rest and (not head or head[-1].isspace()) or _EDGE.search(" ".join(["|", *[rest[i] for i in gaps], "|"])):
                    head, *rest = _CUT.split(t)
                    found = list(map(get, rest))
                    gaps = [i for i, x in enumerate(found) if x is None]
                missing += [rest[i] for i in gaps]
            heads.add(head)
            rows.append((head, rest, found, gaps))
        first = list(heads)
        first_ids = dict(zip(first, self._ids(first), strict=True))
        new = self._chunk_ids(list(set(missing)))
        room = self.most - len(self.cache)
        if room > 0:
            self.cache.update(islice(((x, i) for x, i in new.items() if len(x) <= CACHE_CHARS and "\n" not in x and not x[-1].isspace()), room))
        for _, rest, found, gaps in rows:
            for i in gaps:
                found[i] = new[rest[i]]
        return [b"".join([first_ids[head], *found]) for head, _, found, _ in rows]


def _single_thread() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def json_encoder(path: str) -> ChunkEncoder:
    """Encodes as tokenizers does with the vocabulary file, with add_special_tokens=False."""

    def make() -> ChunkEncoder:
        _single_thread()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return ChunkEncoder(lambda strings: [e.ids for e in t.encode_batch_fast(strings, add_special_tokens=False)], special=tuple(x.content for x in t.get_added_tokens_decoder().values()))

    return held(("json_encoder", path), make)


class RankCodec:
    """Encodes by a rank file with the tokenizers library, and decodes by the file's byte table.

    Merging by the ranks' order gives the ids of the ranks' own library: tests hold every kind of text against it.
    """

    def __init__(self, path: str, pattern: str):
        _single_thread()
        ranks = read_ranks(path)
        self.table = {i: t for t, i in ranks.items()}
        tok = tokenizer_from_ranks(ranks, pattern)
        self.encode = ChunkEncoder(lambda strings: [e.ids for e in tok.encode_batch_fast(strings, add_special_tokens=False)])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids, each by the table; a character may be split over ids, so only the whole is text."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Code point offsets (start, end) of each id in the text; ids within one character all have that character's."""
        ids = np.frombuffer(self.encode([text])[0], dtype="<u4").tolist()
        ends = np.cumsum([0, *(len(self.table[i]) for i in ids)])
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        return [(int(char[a]), int(char[b - 1]) + 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def rank_codec(path: str, pattern: str) -> RankCodec:
    return held(("rank_codec", path, pattern), lambda: RankCodec(path, pattern))


ENCODED = "doc_id long, ids binary, n_tokens long, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_decode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encode every text whole by a rank file, and decode the ids again.

    Returns one row per input row: doc_id, ids (little-endian unsigned 32-bit), n_tokens, decoded bytes; with digests=True
    instead SHA-256 of the decimal ids joined by commas and of the decoded bytes, and whether they are the text's bytes.
    Null texts count as empty (no ids, no bytes); a null doc_id stays null; rows that repeat are each encoded; other columns
    are ignored. Nothing is shuffled: each batch is cut by bytes, and a text is held once at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(path, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]) if digests else pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.binary())])
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                ids = codec.encode(texts)
                doc = batch.column(0).slice(a, b - a)
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                decoded = [codec.decode(i) for i in ids]
                if not digests:
                    yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.binary()), n, pa.array(decoded, pa.binary())], schema=schema)
                    continue
                sha = [hashlib.sha256(",".join(map(str, np.frombuffer(i, dtype="<u4").tolist())).encode()).hexdigest() for i in ids]
                same = [d == t.encode() for d, t in zip(decoded, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([doc, n, pa.array(sha), pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array(same)], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, DIGESTS if digests else ENCODED)

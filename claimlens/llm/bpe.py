"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over code points cuts every text into chunks, at places that
depend on the nearby content only, so a passage that many documents share gives
the same chunks in all of them. The part of a chunk from its first to its last
space is its interior. Interiors whose digest occurs twice or more in the corpus
are encoded once, in a job of their own, and joined back; all others are encoded
where they are read.

What lies between two interiors (the seam: the end of one chunk and the start of
the next) is repaired: seam and neighbouring words are encoded again as one
string, and the ids must begin with those of the word before and end with those
of the word after; if not, more words are taken in until they agree. A text
whose interiors are used up before that is encoded as a whole by the library, and
so is every text for a tokenizer whose pre-tokens hold spaces (`parted`). A chunk
without a space is wholly part of a seam.

Which interiors are shared is found by counting digests (partial counts, no
text), and sent to the readers as a bit map of limited size (bits.MOST); a false hit
only means that an interior takes the longer way. Texts without a shared
interior never leave their task. Equal texts are put together once.

Defined cases: a null text is an empty one; an empty text has no ids and decodes
to the empty string; a very long text is cut like any other, and a run of it without
spaces is one seam, encoded in one piece; repeated rows each get their result; null doc_id is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.batches import pieces as pieces_of
from claimlens.llm.batches import sole, tidy
from claimlens.llm.bits import BitMap, bit_map
from claimlens.llm.units import _LOADED, id_type, tokenizer, unit_encoder
from claimlens.session import materialize, release

MEAN_BITS, LEAST, MOST, WINDOW = 11, 512, 16_384, 16
#: Code points in which a word near a seam is looked for.
NEAR = 64
_MULTIPLY = np.uint32(0x01000193)
#: Digests and texts that a task remembers having sent, so that copies in it are sent once.
REMEMBERED = 200_000
#: Bytes of the texts that a task takes apart at a time; it holds them several times over.
TEXTS = 1 << 20


def cuts(text: str) -> list[int]:
    """Ends of the chunks, in code points; the last is the text's length."""
    n = len(text)
    if n <= LEAST:
        return [n]
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    factor, span = _MULTIPLY, 1
    while span < WINDOW:  # each step doubles the window that the hash covers
        h[span:] = h[span:] + h[:-span] * factor
        factor = np.uint32((int(factor) * int(factor)) & 0xFFFFFFFF)
        span *= 2
    found, last, out = np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1, 0, []
    for at in found.tolist():
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST and at < n:
            out.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def parts(text: str) -> list[str]:
    """Seams and interiors in turn; the first and the last part are seams."""
    out, seam, start = [], "", 0
    for end in cuts(text):
        chunk = text[start:end]
        start = end
        p, q = chunk.find(" "), chunk.rfind(" ")
        if p == q:
            seam += chunk
        else:
            out += (seam + chunk[:p], chunk[p:q])
            seam = chunk[q:]
    return [*out, seam]


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def words(text: str) -> list[str]:
    """A line end counts as a space for this tokenizer, so both part units."""
    return text.replace("\n", " ").split(" ")


class Disagree(Exception):
    """No repair of a seam agrees with its interiors."""


def parted(tok) -> bool:
    """Whether white space parts the pre-tokens of a tokenizer, so that words can be encoded alone."""
    text = "ab, Cd 12\nef (gh)  ij. don't xyz"
    if not tok.pre_tokenizer:
        return False
    normal = tok.normalizer.normalize_str(text) if tok.normalizer else text
    pieces = [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(normal)]
    apart = [i for w in words(text) if w for i in tok.encode(w, add_special_tokens=False).ids]
    return not any(c.isspace() for p in pieces for c in p) and apart == tok.encode(text, add_special_tokens=False).ids


class Encoder:
    def __init__(self, path: str):
        self.tok, self.units, self.kind = tokenizer(path), unit_encoder(path), id_type(path)
        self.parted = parted(self.tok)
        self.width = int(self.kind[-1])
        size = self.tok.get_vocab_size()
        self.names, self.digits = [self.tok.id_to_token(i) or "" for i in range(size)], [str(i) for i in range(size)]

    def interior(self, text: str) -> bytes:
        return b"".join(self.units.values(words(text)))

    def seam(self, left: str, seam: str, right: str) -> bytes:
        """ids of a seam between two interiors (either may be empty)."""
        if not seam.strip(" "):
            return b""
        n = 1
        while True:
            a, b = self.near(left, n, -1), self.near(right, n, 1)
            text = " ".join([*a, ""]) + seam + " ".join(["", *b])
            got = np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
            x, y = b"".join(self.units.values(a)), b"".join(self.units.values(b))
            if got.startswith(x) and got[len(x) :].endswith(y):
                return got[len(x) : len(got) - len(y)]
            if NEAR * n >= max(len(left), len(right)):
                raise Disagree
            n *= 2

    @staticmethod
    def near(text: str, n: int, side: int) -> list[str]:
        """Up to n whole words from an end (side 1: the start, -1: the end) of an interior."""
        some = text[: NEAR * n] if side > 0 else text[-NEAR * n :]
        got = words(some)
        if len(some) < len(text):  # the word at the cut may not be whole
            got = got[:-1] if side > 0 else got[1:]
        got = [w for w in got if w]
        return got[:n] if side > 0 else got[-n:]

    def whole(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(self.interior(p) if i % 2 else self.between(pieces, i) for i, p in enumerate(pieces))
        except Disagree:
            return self.jointly("".join(pieces))

    def jointly(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def between(self, pieces: list[str], i: int) -> bytes:
        return self.seam(pieces[i - 1] if i else "", pieces[i], pieces[i + 1] if i + 1 < len(pieces) else "")

    def decode(self, ids: list[int]) -> str:
        """As the library's decode for a tokenizer that names no decoder: tokens joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def result(self, data: bytes) -> tuple[int, str, str]:
        ids = np.frombuffer(data, self.kind).tolist()
        shown = " ".join(map(self.digits.__getitem__, ids))
        text = self.decode(ids) if self.tok.decoder is None else self.tok.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    sole(_ENCODERS, _LOADED)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n): how often an interior occurs in some texts, repeats within a text included."""
    seen: dict[bytes, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"digest": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    for batch in batches:
        for text in batch.column(0):
            for p in parts(text.as_py() or "")[1::2]:
                d = digest(p)
                seen[d] = seen.get(d, 0) + 1
            if len(seen) >= REMEMBERED // 2:
                yield rows()
                seen = {}
    yield rows()


def shared_map(docs: DataFrame) -> BitMap:
    """The digests that occur twice or more."""
    counts = docs.select("text").mapInArrow(tidy(_digests), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 1").select("digest"), "shared")
    found = bit_map(counts, F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"))
    release(counts)
    return found


_ROW = "kind int, doc_id long, tkey binary, pos int, digest binary, ids binary, text string, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in _ROW.split(", ")]
#: Kinds of rows that the readers give.
DONE, DOC, RUN, REF, CHUNK = range(5)


def _read(path: str, shared) -> object:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bits, sent = encoder(path), shared.value, set()

        def new(key) -> bool:
            if key in sent:
                return False
            if len(sent) < REMEMBERED:
                sent.add(key)
            return True

        def maybe(d: bytes) -> bool:
            return int.from_bytes(d[:4], "big") in bits

        def rows(doc_id, text: str) -> Iterator[tuple]:
            try:
                yield from in_chunks(doc_id, text)
            except Disagree:  # raised before the first row of a text is given
                yield (DONE, doc_id, None, None, None, None, None, *enc.result(enc.jointly(text)))

        def in_chunks(doc_id, text: str) -> Iterator[tuple]:
            if not enc.parted:
                raise Disagree
            pieces = parts(text)
            marks = [digest(p) if i % 2 else None for i, p in enumerate(pieces)]
            if not any(d and maybe(d) for d in marks):
                yield (DONE, doc_id, None, None, None, None, None, *enc.result(enc.whole(pieces)))
                return
            seams = {i: enc.between(pieces, i) for i in range(0, len(pieces), 2)}
            key = digest(text)
            yield (DOC, doc_id, key, *[None] * 7)
            if not new(("t", key)):
                return
            run, pos = [], 0
            for i, (p, d) in enumerate(zip(pieces, marks)):
                if d and maybe(d):
                    yield (RUN, None, key, pos, None, b"".join(run), *[None] * 4)
                    yield (REF, None, key, pos + 1, d, *[None] * 5)
                    if new(d):
                        yield (CHUNK, None, None, None, d, None, p, *[None] * 3)
                    run, pos = [], pos + 2
                else:
                    run.append(enc.interior(p) if i % 2 else seams[i])
            yield (RUN, None, key, pos, None, b"".join(run), *[None] * 4)

        for batch in pieces_of(batches, size=TEXTS):
            out = [r for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows(d, t or "")]
            columns = list(zip(*out)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    return tidy(read)


def _encode_chunks(path: str):
    def encode(batches):
        enc = encoder(path)
        for b in pieces_of(batches):
            ids = [enc.interior(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["digest", "ids"])

    return tidy(encode)


def _assemble(path: str):
    def assemble(batches):
        enc = encoder(path)
        for b in pieces_of(batches):
            got = [enc.result(b"".join(p["ids"] for p in ps)) for ps in b.column(1).to_pylist()]
            columns = list(zip(*got)) or [(), (), ()]
            arrays = [b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["tkey", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tidy(assemble)


def op2_bpe(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(shared_map(docs))
    rows = materialize(docs.mapInArrow(_read(path, shared), _ROW), "bpe")
    chunks = rows.where(F.col("kind") == CHUNK).groupBy("digest").agg(F.first("text").alias("text"))
    encoded = materialize(chunks.mapInArrow(_encode_chunks(path), "digest binary, ids binary"), "encoded")  # the shuffled texts go before ids are shuffled
    refs = rows.where(F.col("kind") == REF).groupBy("tkey", "pos").agg(F.first("digest").alias("digest"))
    refs = refs.join(encoded, "digest").select("tkey", "pos", "ids")
    # One shuffle by text serves both groupings: copies read in several tasks give the same runs, of which one counts.
    placed = rows.where(F.col("kind") == RUN).select("tkey", "pos", "ids").unionByName(refs).repartition("tkey")
    one = placed.groupBy("tkey", "pos").agg(F.first("ids").alias("ids"))
    texts = one.groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    made = materialize(texts.mapInArrow(_assemble(path), "tkey binary, n_tokens long, ids_sha256 string, decoded_sha256 string"), "made")
    release(encoded)
    out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    joined = rows.where(F.col("kind") == DOC).select("doc_id", "tkey").join(made, "tkey").select(out)
    return rows.where(F.col("kind") == DONE).select(out).unionByName(joined)

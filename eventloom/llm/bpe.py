"""BPE encoding and decoding through a table of distinct words.

A tokenizer whose pre-tokens never cross white space gives the same ids for a text
as for its blank-separated words one after the other.  So:

1. chunks of documents are split into words in Spark tasks; a chunk keeps, per
   document, the index of each word in the chunk's list of distinct words;
2. the distinct words go to buckets by their hash; a bucket meets each word of the
   corpus once, encodes it once and answers every chunk that asked;
3. the answers join the chunk again and ids fall into place by position;
4. ids become pieces through the id-to-piece table and pieces the decoded text.

No row of a shuffle is one word occurrence, a frequent word is asked for once a
chunk, and a chunk has a bounded number of bytes, so no key gathers a large group.

Defined results: a null text is the empty text (no ids, empty decoded text); rows
with a null doc_id are left out; of rows with one doc_id the greatest text counts;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from .common import arrow, keyed, slices, trim

#: Text bytes of a chunk.
CHUNK_BYTES = 5 << 20
#: Words that a worker keeps the ids of, at most.
CACHE_WORDS = 150_000
_held: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of single words by the tokenizers library, kept in a bounded table."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.ids: dict[str, bytes] = {}
        self.known, self.starts, self.lens, self.flat = pa.array([""]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.most = most
        self.pieces = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]

    @staticmethod
    def _base(word: str) -> tuple[str, str]:
        """A Latin-1 word in lower case without its last full stop or comma, and that mark.

        The tokenizer lower-cases letter by letter and always cuts between a letter
        and a mark, so both parts have the ids that they have in the word.
        """
        if word.isascii() or max(word) < "Ā":
            word = word.lower()
            if len(word) > 1 and word[-1] in ".," and word[-2].isalpha() and "<" not in word:
                return word[:-1], word[-1]
        return word, ""

    def __call__(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        if len(self.ids) > self.most:
            self.ids.clear()
        parts = [self._base(w) if "<|" not in w else (w, "") for w in words]
        ids = self.ids
        new = list(dict.fromkeys(x for p in parts for x in p if x and x not in ids))
        step = self.most // 12  # encodings of the library are large
        for at in range(0, len(new), step):
            some = new[at : at + step]
            for w, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids[w] = np.array(e.ids, "<u4").tobytes()
        return [ids[a] + ids[b] if b else ids[a] for a, b in parts]


    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids one after the other); as ``__call__``, by columns."""
        latin = pc.and_not(pc.match_substring_regex(words, r"\A[\x{00}-\x{FF}]*\z"), pc.match_substring(words, "<|"))
        base = pc.if_else(latin, pc.utf8_lower(words), words)
        cut = pc.and_(latin, pc.match_substring_regex(base, r"\A[^<]*[a-z\x{AA}\x{B5}\x{BA}\x{DF}-\x{F6}\x{F8}-\x{FF}][.,]\z"))
        mark = pc.if_else(cut, pc.utf8_slice_codeunits(base, -1), "")
        parts = pa.concat_arrays([pc.if_else(cut, pc.utf8_slice_codeunits(base, 0, -1), base), mark])
        if len(self.known) > self.most:
            self.known, self.starts, self.lens, self.flat = self.known[:1], self.starts[:1], self.lens[:1], self.flat[:0]
        at = pc.index_in(parts, self.known)
        lost = parts.filter(at.is_null())
        new = pc.unique(lost)
        at = np.array(at.fill_null(-1), np.int64)
        at[at < 0] = len(self.known) + np.asarray(pc.index_in(lost, new))
        step = min(50_000, self.most // 12)  # encodings of the library are large
        lens, flat = [self.lens], [self.flat]
        for i in range(0, len(new), step):
            ids = [e.ids for e in self.tok.encode_batch_fast(new.slice(i, step).to_pylist(), add_special_tokens=False)]
            lens.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        self.known = pa.concat_arrays([self.known, new])
        self.lens, self.flat = np.concatenate(lens), np.concatenate(flat)
        self.starts = np.cumsum(self.lens) - self.lens
        at = at.reshape(2, -1).T.ravel()
        return self.lens[at].reshape(-1, 2).sum(1), spread(at, self.starts, self.lens, self.flat)


def encoder(path: str, most: int = CACHE_WORDS) -> WordEncoder:
    if path not in _held:
        _held.clear()
        _held[path] = WordEncoder(path)
    _held[path].most = most
    return _held[path]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words per text, index of each word in the distinct words, distinct words), cut at blanks and line ends."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = pc.dictionary_encode(lists.flatten())
    idx = np.asarray(flat.indices)
    full = np.asarray(pc.greater(pc.binary_length(flat.dictionary), 0))
    kept = full[idx] if len(idx) else np.empty(0, bool)
    sums = np.concatenate([[0], np.cumsum(kept)])
    at = offsets - offsets[0]
    new = np.cumsum(full) - 1
    return np.diff(sums[at]), new[idx[kept]] if len(idx) else idx, flat.dictionary.filter(pa.array(full))


def spread(idx: np.ndarray, starts: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lens[i]] for each i of idx, in one array."""
    n = lens[idx]
    total = int(n.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[idx] - (ends - n), n) + np.arange(total)]


def encode_texts(texts: pa.Array, enc: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids per text, all ids one after the other)."""
    counts, idx, words = split_words(texts)
    lens, flat = enc.table(words)
    starts = np.cumsum(lens) - lens
    out = spread(idx, starts, lens, flat)
    sums = np.concatenate([[0], np.cumsum(lens[idx])]) if len(idx) else np.zeros(1, np.int64)
    return np.diff(sums[np.concatenate([[0], np.cumsum(counts)])]), out


def _pack(a: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    a = np.ascontiguousarray(a, "<u4")
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel()


#: Rows of a chunk have keys from here on; below are buckets of words.
_FIRST = 1 << 50
_CHUNK = "key long, chunk long, a binary, b binary, c binary"


def _row(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_CHUNK_PA = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _chunks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = _FIRST + (TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch, limit=CHUNK_BYTES):
                counts, idx, words = split_words(part.column(1))
                ids = np.asarray(part.column(0), dtype=np.int64)
                rows = [(chunk, len(words), ids.tobytes(), _pack(counts), _pack(idx))]
                text = words.to_pylist()
                raw = [w.encode() for w in text]
                where = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") % buckets for w in raw), np.int64, len(raw))
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                for k in range(buckets):
                    mine = order[cuts[k] : cuts[k + 1]]
                    if len(mine):
                        rows.append((k, chunk, zstandard.compress(b"\n".join([raw[i] for i in mine.tolist()]), 1), _pack(np.diff(mine, prepend=0)), None))
                yield _row(_CHUNK_PA, rows)
                chunk += 1

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for r in batch.filter(pc.less(batch.column(0), _FIRST)).to_pylist():
                ids = enc(zstandard.decompress(r["a"]).decode().split("\n"))
                yield _row(_CHUNK_PA, [(r["chunk"], r["key"], zstandard.compress(b"".join(ids), 1), r["b"], _pack(np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))))])
        enc.ids.clear()  # other tasks have other words

    return run


def _assemble(head: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(doc ids, word counts, word indexes, ids by word) of a chunk."""
    (h,) = head.to_pylist()
    counts, idx = _unpack(h["b"]).astype(np.int64), _unpack(h["c"]).astype(np.int64)
    ids: list[bytes | None] = [None] * h["chunk"]  # in a chunk's own row this holds its number of distinct words
    for r in answers.to_pylist():
        flat, at = zstandard.decompress(r["a"]), 0
        for i, n in zip(np.cumsum(_unpack(r["b"]).view("<i4").astype(np.int64)).tolist(), _unpack(r["c"]).tolist(), strict=True):
            ids[i] = flat[at : at + 4 * n]
            at += 4 * n
    if None in ids:
        raise RuntimeError("a chunk lacks ids of some of its words")
    return np.frombuffer(h["a"], np.int64), counts, idx, ids


def encode(docs: DataFrame, path: str, finish, schema: str, out: pa.Schema) -> DataFrame:
    """Encode whole texts; ``finish`` turns (doc ids, word counts, word indexes, ids by word, encoder) of a chunk into record batches.

    Chunks and word lists leave the documents through one exchange, which both the
    encoding and the join back read; the words wait there for their ids.
    """
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = arrow(keyed(docs), _chunks(buckets), _CHUNK).repartition(buckets, "key")
    asked = arrow(dealt, _encode(path), _CHUNK)

    def last(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows or chunk["key"][0].as_py() < _FIRST:
            return out.empty_table()
        done = pa.Table.from_batches(list(finish(*_assemble(chunk, answers), encoder(path))), schema=out)
        trim()
        return done

    return dealt.groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(last, schema)


_DIGEST_PA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(doc_ids, counts, idx, by_word, enc):
    """Digest columns: decimal ids and decoded pieces of each whole document, joined by position."""
    n = np.fromiter((len(x) // 4 for x in by_word), np.int64, len(by_word))
    pieces, digits, decoded = enc.pieces, [], []
    for k, x in enumerate(by_word):  # each word's ids go as its digits and pieces come
        ids = np.frombuffer(x, "<u4").tolist()
        digits.append(" ".join(map(str, ids)).encode())
        decoded.append(" ".join([pieces[i] for i in ids]).encode())
        by_word[k] = None
    sums = np.concatenate([[0], np.cumsum(n[idx])]) if len(idx) else np.zeros(1, np.int64)
    ends, out = np.cumsum(counts), ([], [])
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        mine = idx[a:b]
        mine = mine[n[mine] > 0].tolist()
        for table, to in zip((digits, decoded), out, strict=True):
            to.append(hashlib.sha256(b" ".join([table[i] for i in mine])).hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(sums[ends] - sums[ends - counts]), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], schema=_DIGEST_PA)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole document."""
    return encode(docs, path or tokenizer_path(), _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _DIGEST_PA)


_TEXT_PA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _texts(doc_ids, counts, idx, by_word, enc):
    ends = np.cumsum(counts)
    for d, a, b in zip(doc_ids.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
        ids = np.frombuffer(b"".join([by_word[i] for i in idx[a:b].tolist()]), "<u4").tolist()
        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([ids], pa.list_(pa.int32())), pa.array([" ".join([enc.pieces[i] for i in ids])])], schema=_TEXT_PA)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of each whole document."""
    return encode(docs, path or tokenizer_path(), _texts, "doc_id long, ids array<int>, decoded string", _TEXT_PA)

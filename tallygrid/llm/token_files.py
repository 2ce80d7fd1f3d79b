"""Token ids as binary files of byte or bit planes.

Texts are tokenized in order of doc_id and written as a table of segments in the shared folder. A segment holds whole
documents: their ids and lengths, and the token ids cut into blocks of BLOCK ids. Each block is transposed into planes
(the k-th byte, or the k-th bit, of all its ids) and each plane is compressed by itself, so the many equal high bytes
cost nothing. `blocks` and `planes` are the index: ids of each block and bytes of each of its planes in `payload`.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import chunks, dealt_by_ranges, give_back, lean, shared_dir, table, unpacked

BLOCK = 1 << 16
END_ID = 1
LEVEL = 3
SEGMENTS = "run int, segment int, start long, doc_ids array<long>, lengths array<long>, blocks array<int>, planes array<int>, kind string, payload binary"
SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.binary()]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of vocabulary files whose pieces WordTokenizer cuts itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuts_words(path: str) -> bool:
    """Whether a vocabulary file has the rules above, marker strings of the form <|...|> only, and nothing else that
    would change the ids of a piece."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model = rules["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    marks = all(t["content"].startswith("<|") and t["content"].endswith("|>") and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in rules.get("added_tokens") or [])
    return plain and marks and rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and not any(rules.get(k) for k in ("post_processor", "truncation", "padding"))


class WordTokenizer:
    """The tokenizer's ids of whole texts, with each distinct piece of text tokenized once.

    A vocabulary with the rules above lower-cases, drops white space and cuts the rest into runs of letters, single
    digits and runs of other characters, none of which it joins. So a text's ids are those of its pieces in a row. For
    plain words (ASCII and Latin-1 letters) the cuts are made here, for all texts of a chunk at once; other words
    (apostrophes, other scripts, marker strings) are one piece each. New plain pieces go to the library's BPE many at a
    time, new other ones through the unchanged tokenizer.

    A piece is looked up by a hash and then compared with the bytes that were learnt under it: up to 16 bytes are two
    numbers, longer ones are kept as text. A text with a piece that differs goes through the unchanged tokenizer, as do
    all texts under a vocabulary with other rules.
    """

    MOST_PIECES, MOST_TEXT = 1_500_000, 64 << 20
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.fast = cuts_words(path)
        if not self.fast:
            return
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 what makes a word odd (0xC3 and what follows it is seen to apart)
        self.kind = np.full(256, 3, np.uint8)
        self.kind[:32], self.kind[127:], self.kind[39] = 4, 4, 4
        self.kind[[32, 9, 10, 13]] = 0
        self.kind[65:91], self.kind[97:123], self.kind[48:58] = 1, 1, 2
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.clear()

    def clear(self) -> None:
        """Entry 0 is the end mark, which no piece has."""
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = np.array([END_ID], np.uint32)
        self.at, self.n = np.array([0], np.int64), np.array([1], np.int64)
        self.heads, self.tails = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.sizes = np.zeros(1, np.int64)  # bytes, below 0 for an odd word
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def marks(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first 8 bytes, next 8 bytes, size or for odd words its negative) of each piece."""
        size = ends - starts
        padded = np.concatenate([low, np.zeros(24, np.uint8)])
        eight = np.ndarray(len(low) + 16, "<u8", padded, strides=(1,))
        heads = eight[starts] & self.MASKS[np.minimum(size, 8)]
        tails = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(size > 8)
        tails[more] = eight[starts[more] + 8] & self.MASKS[np.minimum(size[more] - 8, 8)]
        signed = np.where(odd, -size, size)
        key = heads * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key = (key + tails) * np.uint64(0xC2B2AE3D27D4EB4F) + signed.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        key ^= key >> np.uint64(32)
        long = np.flatnonzero(size > 16)
        raw = low.tobytes() if len(long) else b""
        key[long] ^= np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], np.uint64)
        return key, heads, tails, signed

    def agrees(self, where: np.ndarray, low: np.ndarray, starts: np.ndarray, heads: np.ndarray, tails: np.ndarray, signed: np.ndarray) -> np.ndarray:
        """Whether the pieces are those that were learnt in these slots."""
        same = (self.heads[where] == heads) & (self.tails[where] == tails) & (self.sizes[where] == signed)
        long = np.flatnonzero(same & (np.abs(signed) > 16))
        if len(long):
            size = np.abs(signed[long])
            unlike = low[runs(starts[long], size)] != self.text[runs(self.text_at[where[long]], size)]
            same[long] = np.add.reduceat(unlike, np.cumsum(size) - size) == 0
        return same

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, starts and ends of the pieces, whether each is an odd word)."""
        kind, low = self.kind[data], self.lower[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        good = (after >= 0x80) & (after != 0x97) & (after != 0xB7)
        lead, after = lead[good], after[good]
        kind[lead] = kind[lead + 1] = 1
        low[lead + 1] = np.where(after < 0x9F, after + 0x20, after)
        kind[1:][(data[1:] == 124) & (data[:-1] == 60)] = 4
        first = np.zeros(len(data), bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        inside = kind != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:]
        change = begins.copy()
        change[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        starts, words = np.flatnonzero(change), np.flatnonzero(begins)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | first[1:]
        word_ends = np.flatnonzero(closes) + 1
        odd_bytes = np.flatnonzero(kind == 4)
        odd_word = np.zeros(len(words), bool)
        odd_word[np.searchsorted(words, odd_bytes, "right") - 1] = True
        of = np.cumsum(begins[starts]) - 1
        keep = ~odd_word[of] | begins[starts]
        starts, of = starts[keep], of[keep]
        ends = np.minimum(np.append(starts[1:], len(data)), word_ends[of])
        odd = odd_word[of]
        ends[odd] = word_ends[of[odd]]
        return low, starts, ends, odd

    def learn(self, raw: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray, keys: np.ndarray, heads: np.ndarray, tails: np.ndarray, signed: np.ndarray) -> None:
        """Adds pieces that aren't known yet; keys are in order."""
        n, parts = np.zeros(len(keys), np.int64), []
        plain = np.flatnonzero(~odd)
        order = []
        for lo in range(0, len(plain), 20_000):
            some = plain[lo : lo + 20_000]
            size = ends[some] - starts[some]
            text = np.full(int(size.sum()) + len(some), 32, np.uint8)
            to = np.cumsum(size + 1) - size - 1
            text[runs(to, size)] = low[runs(starts[some], size)]
            ids = np.array(self.pieces.encode(text[:-1].tobytes().decode("utf-8"), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the vocabulary's pieces don't end as expected")
            n[some] = np.diff(stops, prepend=0)
            parts.append(ids)
            order.append(some)
        strange = np.flatnonzero(odd)
        if len(strange):
            texts = [raw[a:b].tobytes().decode("utf-8") for a, b in zip(starts[strange].tolist(), ends[strange].tolist(), strict=True)]
            for k, e in zip(strange.tolist(), self.whole.encode_batch(texts, add_special_tokens=False), strict=True):
                n[k] = len(e.ids)
                parts.append(np.array(e.ids, np.uint32))
            order.append(strange)
        order = np.concatenate(order)
        at = np.zeros(len(keys), np.int64)
        at[order] = len(self.ids) + np.cumsum(n[order]) - n[order]
        slots = np.arange(len(self.at), len(self.at) + len(keys))
        self.ids = np.concatenate([self.ids, *parts])
        self.at, self.n = np.append(self.at, at), np.append(self.n, n)
        self.heads, self.tails, self.sizes = np.append(self.heads, heads), np.append(self.tails, tails), np.append(self.sizes, signed)
        size = np.where(np.abs(signed) > 16, np.abs(signed), 0)
        self.text_at = np.append(self.text_at, len(self.text) + np.cumsum(size) - size)
        self.text = np.append(self.text, low[runs(starts, size)])
        both = np.append(self.keys, keys)
        by = np.argsort(both, kind="stable")
        self.keys, self.slots = both[by], np.append(self.slots, slots)[by]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each with END_ID at its end, and the number of each text."""
        if not self.fast:
            return joined(self.as_whole(data, offsets, range(len(offsets) - 1)))
        low, starts, ends, odd = self.cut(data, offsets) if len(data) else (data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        if odd.any():  # odd words are told apart by their own bytes, not the lower-cased ones
            spots = runs(starts[odd], ends[odd] - starts[odd])
            low[spots] = data[spots]
        key, *marks = self.marks(low, starts, ends, odd)
        keys, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.MOST_PIECES or len(self.text) > self.MOST_TEXT:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            pick = first[~known]
            self.learn(data, low, starts[pick], ends[pick], odd[pick], keys[~known], *(x[pick] for x in marks))
            place = np.searchsorted(self.keys, keys)
        where = self.slots[place][back] if len(keys) else np.zeros(0, np.int64)
        unlike = np.flatnonzero(~self.agrees(where, low, starts, *marks))
        stops = np.searchsorted(starts, offsets[1:], "left")
        where = np.insert(where, stops, 0)
        n = self.n[where]
        total = np.cumsum(n)
        ids = self.ids[runs(self.at[where], n)]
        last = total[stops + np.arange(len(stops))] if len(stops) else np.zeros(0, np.int64)
        n = np.diff(last, prepend=0)
        if len(unlike):
            texts = np.split(ids, last[:-1])
            rows = np.unique(np.searchsorted(offsets, starts[unlike], "right") - 1).tolist()
            for row, own in zip(rows, self.as_whole(data, offsets, rows), strict=True):
                texts[row] = own
            return joined(texts)
        return ids, n

    def as_whole(self, data: np.ndarray, offsets: np.ndarray, rows) -> list[np.ndarray]:
        """The ids of some texts, each with END_ID at its end, by the unchanged tokenizer."""
        texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8") for r in rows]
        return [np.array([*e.ids, END_ID], np.uint32) for e in self.whole.encode_batch(texts, add_special_tokens=False)]


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *texts]), np.array([len(x) for x in texts], np.int64)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, in a row."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block of ids: 4 of bytes or 32 of bits."""
    if kind == "byte":
        return [x.tobytes() for x in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view("<u4").ravel()[:n]
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


def encoded(ids: np.ndarray, kind: str, block: int = BLOCK, level: int = LEVEL) -> tuple[list[int], list[int], bytes]:
    press = zstandard.ZstdCompressor(level=level)
    blocks, sizes, parts = [], [], []
    for lo in range(0, len(ids), block):
        some = ids[lo : lo + block]
        blocks.append(len(some))
        for plane in planes_of(some, kind):
            parts.append(press.compress(plane))
            sizes.append(len(parts[-1]))
    return blocks, sizes, b"".join(parts)


def decoded(blocks: list[int], sizes: list[int], payload: bytes, kind: str) -> np.ndarray:
    press, at, out = zstandard.ZstdDecompressor(), 0, []
    each = 4 if kind == "byte" else 32
    for k, n in enumerate(blocks):
        planes = []
        for size in sizes[k * each : (k + 1) * each]:
            planes.append(press.decompress(payload[at : at + size]))
            at += size
        out.append(ids_of(planes, n, kind))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def segment_writer(path: str, kind: str):
    def write(rows: pa.Table) -> pa.Table:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        tokenizer = _TOKENIZERS[path]
        run = rows.column("run")[0].as_py()
        rows = unpacked(rows.column("block"))
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        ids, out, start = rows.column("doc_id"), [], 0
        for lo, hi, data, at in chunks(rows.column("text")):
            tokens, n = tokenizer.encode(data, at)
            blocks, planes, payload = encoded(tokens, kind)
            out.append((run, len(out), start, ids[lo:hi].to_pylist(), n.tolist(), blocks, planes, kind, payload))
            start += len(tokens)
        cols = list(zip(*out, strict=True)) or [[]] * len(SEGMENT_TYPES)
        return pa.table([pa.array(c, t) for c, t in zip(cols, SEGMENT_TYPES, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return lean(write)


def write_token_files(documents: DataFrame, to: str, vocabulary: str | None = None, kind: str = "byte") -> str:
    """Writes the ids of every row of documents (doc_id, text) as segments to the folder `to`; its path comes back.

    Order: doc_id (null first), then text (null first). A null text counts as an empty one and has only the end id.
    """
    documents = documents.select("doc_id", "text")
    runs = dealt_by_ranges(documents, "doc_id")
    runs.groupBy("run").applyInArrow(segment_writer(vocabulary or vocabulary_path(), kind), SEGMENTS).write.parquet(to)
    return to


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, decoded from their planes.

    The driver adds up the lengths of the runs (one row for each run, about 16 MB of text).
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    lengths = segments.groupBy("run").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("run").toPandas()
    before = dict(zip(lengths["run"].tolist(), (lengths["n"].cumsum() - lengths["n"]).tolist(), strict=True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, start, doc_ids, n, blocks, planes, kind, payload in zip(*(c for c in batch.columns), strict=True):
                ids = decoded(blocks.as_py(), planes.as_py(), payload.as_buffer(), kind.as_py()).astype("<u4")
                n = np.array(n.as_py(), np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                first = before[run.as_py()] + start.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids.as_py(), pa.int64()), pa.array(first + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            give_back()

    return segments.select("run", "start", "doc_ids", "lengths", "blocks", "planes", "kind", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}")
    return read_token_files(spark, path)

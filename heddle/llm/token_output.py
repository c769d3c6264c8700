"""Token ids as compressed bit planes in binary files, and their reader.

File format (all integers little-endian)::

    magic  b"BPL1"
    chunks, each the planes of BLOCK ids: plane p holds bit p of every id, eight ids to a byte, lowest first;
           a plane that is all zero has length 0, the others are zstandard frames
    lengths: zstandard frame of the documents' id counts as unsigned 32-bit integers
    index: for each chunk its offset (u64), number of ids (u32) and 32 plane lengths (u32)
    footer: offset of lengths (u64), of index (u64), number of chunks (u32), of documents (u32), magic again

Each task writes the files of one range of document ids under names of its own attempt, block by block, and a manifest
table, which Spark commits, lists the files that count. A lost executor's half-written files are in no manifest.

Words are split, counted and put together by Arrow; only a slice's distinct words pass through Python, and of these only
the ones that a bounded memory does not hold pass through the tokenizer.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import byte_lengths, byte_slices, materialise, scratch_path, ship, type_of, worker_memory

MAGIC = b"BPL1"
BLOCK = 1 << 16
#: Ids, and documents, of one file; a longer document still goes to one file whole.
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 20
#: Words that a worker remembers, ids of these and of longer words that it holds, and bytes of text that are split at a time.
CACHE_WORDS, CACHE_IDS, SLICE_BYTES = 800_000, 1 << 22, 1 << 21
#: ASCII marks: a run of them after a letter or digit and before white space is a pre-token of its own.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FOOTER, _CHUNK = struct.Struct("<QQII4s"), struct.Struct("<QI32I")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: ASCII letters and digits, and the last bytes of Latin-1 letters after 0xC3.
_ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LATIN = frozenset(range(0x80, 0xC0)) - {0x97, 0xB7}
#: Small letters of ASCII and Latin-1.
_SMALL_ONLY = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def planes(ids: np.ndarray) -> list[bytes]:
    """The 32 bit planes of a block of unsigned 32-bit ids; empty where no bit is set."""
    used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    wide = -(-used.bit_length() // 8)
    raw = np.unpackbits(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide]), axis=1, bitorder="little").T.copy() if wide else None
    return [np.packbits(raw[p], bitorder="little").tobytes() if used >> p & 1 else b"" for p in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    """The ids of a block; bytes whose planes are all empty cost nothing."""
    wide = -(-max((p + 1 for p, part in enumerate(parts) if part), default=0) // 8)
    bits = np.zeros((n, 8 * wide), np.uint8)
    for p, part in enumerate(parts):
        if part:
            bits[:, p] = np.unpackbits(np.frombuffer(part, np.uint8), count=n, bitorder="little")
    out = np.zeros((n, 4), np.uint8)
    if wide:
        out[:, :wide] = np.packbits(bits, axis=1, bitorder="little")
    return out.view("<u4").reshape(-1)


class FileWriter:
    """Writes one file to an open stream, a block of ids at a time."""

    def __init__(self, out, level: int = 1):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level).compress
        self.at, self.index, self.waiting, self.held, self.lengths = len(MAGIC), bytearray(), [], 0, []
        out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        parts = [self.pack(x) if x else b"" for x in planes(ids)]
        self.index += _CHUNK.pack(self.at, len(ids), *map(len, parts))
        self.out.write(b"".join(parts))
        self.at += sum(map(len, parts))

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.waiting)
            whole = len(ids) - len(ids) % BLOCK
            for at in range(0, whole, BLOCK):
                self._block(ids[at : at + BLOCK])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self, lengths: np.ndarray) -> None:
        """Ends the file of documents with these numbers of ids."""
        if self.held:
            self._block(np.concatenate(self.waiting))
        packed = self.pack(lengths.astype("<u4").tobytes())
        self.out.write(packed + bytes(self.index) + _FOOTER.pack(self.at, self.at + len(packed), len(self.index) // _CHUNK.size, len(lengths), MAGIC))


def encode_file(ids: np.ndarray, lengths: np.ndarray, level: int = 1) -> bytes:
    """The file of documents with these ids, one after the other, and these numbers of ids."""
    from io import BytesIO

    writer = FileWriter(out := BytesIO(), level)
    writer.add(ids)
    writer.close(lengths)
    return out.getvalue()


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a file; raises ValueError for one that is not whole."""
    import zstandard

    at_lengths, at_index, chunks, documents, magic = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
    if data[:4] != MAGIC or magic != MAGIC:
        raise ValueError("not a bit-plane file, or a cut one")
    unpack = zstandard.ZstdDecompressor().decompress
    lengths = np.frombuffer(unpack(data[at_lengths:at_index]), "<u4") if documents else np.empty(0, "<u4")
    blocks = []
    for k in range(chunks):
        at, n, *sizes = _CHUNK.unpack_from(data, at_index + k * _CHUNK.size)
        parts = []
        for size in sizes:
            parts.append(unpack(data[at : at + size]) if size else b"")
            at += size
        blocks.append(from_planes(parts, n))
    ids = np.concatenate(blocks) if blocks else np.empty(0, "<u4")
    if int(lengths.sum(dtype=np.int64)) != len(ids):
        raise ValueError("lengths and ids disagree")
    return ids, lengths


class WordEncoder:
    """Encodes whole UTF-8 texts; repeated words between ASCII white space come from a bounded memory.

    The memory is used only where it cannot change an id: the tokenizer must collapse white space, split on it, drop
    it, and run no step across words. Any other tokenizer gets the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        byte_level = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])[1:]]
        self.by_word = (
            normal == ["NFC", "Replace", "Lowercase"]
            and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
            and "[^\\s\\p{L}\\p{N}]" in first["pattern"].get("Regex", "")
            and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in byte_level)
            and not any(re.search(r"\s", x["content"]) or x.get("lstrip") or x.get("rstrip") for x in spec["added_tokens"])
        )
        #: How the pre-tokenizer writes Latin-1 letters, if the model can be asked for words of letters.
        self.alphabet = None
        if self.by_word and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout"):
            write = self.whole.pre_tokenizer.pre_tokenize_str
            letters = [c for c in map(chr, range(0xDF, 0x100)) if c != "÷"]
            self.alphabet = str.maketrans({c: write(c)[0][0] for c in letters})
        self.special = [x["content"].lower().encode() for x in spec["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        #: Of each word its slot; slot k has the ids flat[ends[k - 1] : ends[k]].
        self.slots: dict[bytes, int] = {}
        self.flat, self.ends, self.n = np.empty(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), 0

    def _fresh(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        ids = [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _fresh_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of small ASCII and Latin-1 letters: they are composed, in lower case and one pre-token each,
        so that only the byte alphabet and the model's merges are left to do."""
        split = self.whole.model.tokenize
        ids = [[t.id for t in split(w.decode() if w.isascii() else w.decode().translate(self.alphabet))] for w in words]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _plain(self, word: bytes) -> tuple[bytes, bytes]:
        """A word as the memory keeps it, and the marks after it. Lower-casing an ASCII word changes no id, as the tokenizer
        does so anyway, but for special tokens, which it looks for before; beside other characters it may, as the
        tokenizer composes first and J has no composite where j has one. Marks at the end, after a letter or digit, are one
        pre-token of their own, so that a word costs the same however many kinds of marks it comes with."""
        if b"<" in word and any(x in word.lower() for x in self.special):
            return word, b""
        bare = word.rstrip(_MARKS)
        if not (bare and (bare[-1] in _ALNUM or (len(bare) > 1 and bare[-2] == 0xC3 and bare[-1] in _LATIN))):
            bare = word
        return (bare.lower() if bare.isascii() else bare), word[len(bare) :]

    def _append(self, new: np.ndarray, lengths: np.ndarray) -> int:
        """Puts ids into new slots; returns the first one's number."""
        first, start = self.n, int(self.ends[self.n - 1]) if self.n else 0
        while len(self.flat) < start + len(new):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.ends) < first + len(lengths):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[start : start + len(new)] = new
        self.ends[first : first + len(lengths)] = start + np.cumsum(lengths)
        self.n += len(lengths)
        return first

    def _ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slots one after the other, their numbers)."""
        starts = np.where(slots > 0, self.ends[slots - 1], 0)
        sizes = self.ends[slots] - starts
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.flat[at], sizes

    def _learn(self, words: list[bytes]) -> None:
        """Slots for new words."""
        # Words of ASCII letters have no marks and are no special token.
        plain = [(w.lower(), b"") if w.isalpha() else self._plain(w) for w in words]
        known = self.slots
        unknown = [w for w in {w for w, _ in plain} | {m for _, m in plain} if w not in known]
        letters = list(filter(_SMALL_ONLY, unknown)) if self.alphabet is not None else []
        if letters:
            first = self._append(*self._fresh_words(letters))
            self.slots.update(zip(letters, range(first, self.n), strict=True))
            unknown = list(set(unknown).difference(letters))
        if unknown:
            first = self._append(*self._fresh([w.decode() for w in unknown]))
            self.slots.update(zip(unknown, range(first, self.n), strict=True))
        slots = self.slots
        for raw, (w, m) in zip(words, plain, strict=True):
            if not m and raw is not w:
                slots[raw] = slots[w]
        if marked := [(raw, slots[w], slots[m]) for raw, (w, m) in zip(words, plain, strict=True) if m]:
            pairs = np.array([pair for _, *pair in marked], np.int64).reshape(-1)
            ids, sizes = self._ids_of(pairs)
            first = self._append(ids, sizes[::2] + sizes[1::2])
            slots.update((raw, first + i) for i, (raw, *_) in enumerate(marked))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a string array without nulls."""
        if not self.by_word:
            return self._fresh(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.slots.get, distinct))
        if missing := [w for w, s in zip(distinct, got, strict=True) if s is None]:
            held = int(self.ends[self.n - 1]) if self.n else 0
            if max(len(self.slots), self.n) + len(missing) > CACHE_WORDS or held > CACHE_IDS:
                self._forget()
                missing = distinct
            self._learn(missing)
            slots = self.slots
            got = list(map(slots.__getitem__, distinct)) if missing is distinct else [slots[w] if s is None else s for w, s in zip(distinct, got, strict=True)]
            for w in missing:
                if len(w) > 64:  # long words come once and would hold much
                    del slots[w]
        ids, sizes = self._ids_of(np.array(got, np.int64))
        # Each distinct word's ids side by side, and then, by Arrow, each word's.
        table = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        out = pa.ListArray.from_arrays(table, pa.array(ids)).take(words.indices).flatten().to_numpy()
        per_word = np.concatenate([[0], np.cumsum(sizes[words.indices.to_numpy()])])
        return out, np.diff(per_word[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, ids, number of ids of each text) of runs of a binary or string array's rows; nulls count as empty.

        A text beyond SLICE_BYTES is worked on in pieces, and its run comes once with each: its ids and their numbers add up.
        """
        texts = pc.fill_null(texts if pa.types.is_binary(texts.type) else texts.cast(pa.binary()), b"")
        for a, b in byte_slices(byte_lengths(texts), SLICE_BYTES):
            if b - a > 1 or not self.by_word:
                yield a, b, *self._slice(texts.slice(a, b - a).cast(pa.string()))
                continue
            text, at = texts[a].as_py(), 0
            while True:
                cut = _SPACE.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
                end = cut.start() if cut else len(text)
                yield a, b, *self._slice(pa.array([text[at:end].decode()], pa.string()))
                if end == len(text):
                    break
                at = end

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        out = [b""] * len(texts)
        for a, b, ids, lengths in self.slices(pa.array(texts, pa.binary())):
            ends = np.cumsum(lengths)
            for i, (x, y) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
                out[a + i] += ids[x:y].astype("<u4").tobytes()
        return out


def _encoder(path: str) -> WordEncoder:
    memory = worker_memory("token output")
    if path not in memory:
        memory[path] = WordEncoder(path)
    return memory[path]


@lru_cache(maxsize=8)
def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else f"file://{path}"


def _open(folder: str, name: str):
    fs, base = _filesystem(_uri(folder))
    fs.create_dir(base, recursive=True)
    return fs.open_output_stream(f"{base}/{name}")


def _read(path: str) -> bytes:
    folder, name = path.rsplit("/", 1)
    fs, base = _filesystem(_uri(folder))
    with fs.open_input_stream(f"{base}/{name}") as data:
        return data.read()


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Writes the sorted rows of a partition; a row of the manifest for each file."""
    from pyspark import TaskContext

    task = TaskContext.get()
    encode = _encoder(tokenizer)
    docs: list[pa.Array] = []
    lengths: list[np.ndarray] = []
    n = n_docs = number = 0
    writer = None

    def flush() -> pa.RecordBatch:
        nonlocal docs, lengths, n, n_docs, number, writer
        writer.close(np.concatenate(lengths))
        writer.out.close()
        keys = pa.concat_arrays(docs)
        row = pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)],
            names=["part", "number", "path", "n_ids", "docs"],
        )
        docs, lengths, n, n_docs, number, writer = [], [], 0, 0, number + 1, None
        return row

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(document ids, their ids with the end id, numbers of ids); a long text's pieces but the last have no document."""
        nothing, before = batch.column(0).slice(0, 0), 0
        found = encode.slices(batch.column(1))
        now = next(found, None)
        while now is not None:
            (a, b, ids, counts), now = now, next(found, None)
            if now is not None and now[0] == a:
                yield nothing, ids, np.empty(0, np.int64)
                before += len(ids)
            else:
                # Pieces of a long text stand alone in their run, so what went before belongs to its one document.
                yield batch.column(0).slice(a, b - a), np.insert(ids, np.cumsum(counts), end_id), counts + 1 + before
                before = 0

    for batch in batches:
        for keys, ids, counts in rows(batch):
            if writer is None:
                name = f"part-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bpl"
                writer = FileWriter(_open(folder, name))
            writer.add(ids.astype("<u4", copy=False))
            docs.append(keys)
            lengths.append(counts)
            n, n_docs = n + len(ids), n_docs + len(keys)
            if len(keys) and (n >= FILE_IDS or n_docs >= FILE_DOCS):
                yield flush()
    if writer is not None:
        yield flush()


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every row's ids and ``end_id`` to files under ``folder``, rows in ascending id order over all files.

    Returns the manifest ``(part, number, path, n_ids, docs, base)``: docs holds the file's document ids in order and
    base counts the ids of all files before it. Null texts are empty. Ids that are null come first; rows with equal
    ids stand side by side, longer texts last, then by a hash, so reruns agree. A very long text is encoded in pieces.
    An empty table writes no file.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # Rows that share an id, or have none, are ranged by their texts, so that they need not meet in one task.
    rows = rows.withColumns({"size": F.octet_length("text"), "hash": F.xxhash64("text")})
    order = ["id", "size", "hash"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")
    schema = f"part int, number int, path string, n_ids long, docs array<{type_of(df, id_col)}>"
    manifest = materialise(ranged.mapInArrow(lambda b: _write_batches(b, folder, tokenizer, end_id), schema), "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # One narrow row per file goes to one task here; files hold 16 million ids each.
    bases = manifest.select("part", "number", "n_ids").select("part", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return manifest.join(F.broadcast(bases), ["part", "number"]) if manifest.count() <= 100_000 else manifest.join(bases, ["part", "number"])


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        for k in range(batch.num_rows):
            ids, lengths = decode_file(_read(batch.column("path")[k].as_py()))
            docs = batch.column("docs")[k].values
            if len(docs) != len(lengths):
                raise ValueError("the manifest and a file disagree")
            ends = np.cumsum(lengths, dtype=np.int64)
            starts, raw, crcs = ends - lengths, memoryview(ids.astype("<u4").tobytes()), []
            for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True):
                crcs.append(zlib.crc32(raw[a:b]))
            base = batch.column("base")[k].as_py()
            for at in range(0, len(docs), 8192):
                to = slice(at, at + 8192)
                yield pa.RecordBatch.from_arrays([docs[to], pa.array(starts[to] + base), pa.array(lengths[to].astype(np.int64)), pa.array(crcs[to], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the files: ``(doc_id, start, n_tokens, ids_crc32)``."""
    ship(manifest.sparkSession)
    kind = manifest.schema["docs"].dataType.elementType.simpleString()
    rows = manifest.select("path", "base", "docs")
    # A file is work for seconds although its row is small, so the number of tasks is given, not left to be coalesced.
    rows = rows.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return rows.mapInArrow(_read_batches, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_output(df: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, writes and reads back all rows; files go to ``folder``, by default one in the shared folder.

    Handles nulls, empty and very long texts, repeated rows and empty tables as :func:`write_token_files` says;
    further columns are ignored, whatever their names.
    """
    folder = folder or scratch_path(df.sparkSession, "tokens")
    return read_token_files(write_token_files(df, folder, tokenizer, end_id, id_col, text_col))

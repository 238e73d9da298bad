"""Token ids in Arrow files with fixed-size-list batches (operator 6).

The ids of a run of documents are one stream, cut into rows of ``length`` ids; the last row is filled with
the end id and its mask is zero there. A file in the Arrow file format holds such rows as a column of
fixed-size lists with their masks, ``ROWS`` to a batch, uncompressed: row r lies in batch r // ROWS at a
known offset, so a memory-mapped reader returns any row without copying. Ids are as narrow as
the vocabulary allows and masks take one bit. Next to each data file lies an index file: the id, first position and length of every document in it.

Documents are dealt to files by ranges of their id (and a hash of the text, so that a repeated id cannot
overfill one file) and sorted in each. Every file is written under a temporary name and then renamed,
so a task that runs twice leaves one whole file.
"""
from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import _shared_folder
from .common import kept, open_uri, raw

END = 0
LENGTH = 1024
ROWS = 256
CHARS_A_FILE = 16_000_000
KEPT_WORDS = 1_200_000
WORDS_A_LINE = 4_000
BYTES_AT_ONCE = 8_000_000


def vocabulary() -> str:
    """Where the public vocabulary is mounted, on the driver and on executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids by the plain call of the tokenizers library, looked up for words met before.

    The library itself splits at a line feed and in front of a space where these stand alone between other
    characters. So texts are cut there into words, those behind a line feed with it, and the distinct words of a
    batch are looked up, all by Arrow; ids are then gathered word by word with NumPy. It also splits between
    letters and marks, so a word that is letters and a mark or three has the ids of both, end to end, and only its
    letters are asked for. A text with other white
    space in such places, with control characters that are white space to one side alone, or with
    the string of a special token goes to the library whole. ``kind`` is the narrowest type that holds every id.
    """

    ODD = re.compile(r"^\n?+(?:\s|$)|\s$|[\x1c-\x1f\x85]")
    MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    #: An apostrophe right behind the letters may belong to them, so it is not cut off.
    ENDED = re.compile(r"(\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)((?!')[!-/:-@\[-`{-~]{1,3})")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.line,) = self.library(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 20, self.kind), 0
        self.start, self.size = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)
        self.met = np.zeros(1 << 18, np.int64)

    def forget_rare(self) -> None:
        """Keep the words that several batches held, half the number allowed at most."""
        n = len(self.number)
        kept = np.flatnonzero(self.met[:n] > 1)
        if len(kept) > KEPT_WORDS // 2:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[:KEPT_WORDS // 2]])
        words = list(self.number)
        words = [words[k] for k in kept.tolist()]
        start, size, met, ids = self.start[kept], self.size[kept], self.met[kept], self.ids
        self.forget()
        self.number.update(zip(words, range(len(words))))
        self._store(np.maximum(size, 0), _gathered(ids, start, np.maximum(size, 0)), 0)
        self.size[:len(kept)] = size
        self.met = np.append(met, np.zeros(max(0, len(self.met) - len(met)), np.int64))

    def _store(self, size: np.ndarray, ids: np.ndarray, at: int) -> None:
        """Keep ``ids``, which are those of the words from number ``at`` on, end to end."""
        last = at + len(size)
        self.start, self.size = _grown(self.start, last), _grown(self.size, last)
        self.start[at:last], self.size[at:last] = self.used + np.cumsum(size) - size, size
        self.ids = _grown(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Number new words and keep their ids; a word of letters and marks gets those of its parts."""
        ended = [m for w in words if w[-1:] in self.MARKS and (m := self.ENDED.fullmatch(w))]
        made = {m[0] for m in ended}
        asked = [w for w in words if w not in made]
        new = set(asked)
        asked += [c for c in dict.fromkeys(m[1] for m in ended) if c not in self.number and c not in new]
        if asked:
            self.ask(asked)
        if not ended:
            return
        # no word holds a blank, so marks behind letters go by names that begin with one
        marks = [x for x in dict.fromkeys(m[2] for m in ended) if " " + x not in self.number]
        if marks:
            ids, first = self.library(marks), len(self.number)
            self.number.update((" " + x, first + k) for k, x in enumerate(marks))
            self._store(np.array([*map(len, ids)]), np.concatenate(ids), first)
        both = np.array([n for m in ended for n in (self.number[m[1]], self.number[" " + m[2]])])
        size, first = self.size[both], len(self.number)
        self.number.update((m[0], first + k) for k, m in enumerate(ended))
        self._store(size.reshape(-1, 2).sum(axis=1), _gathered(self.ids, self.start[both], size), first)

    def ask(self, words: list[str]) -> None:
        """Number words and keep the library's ids; size -1 marks words that must not be cut off.

        Many words are one text to the library, a line each: a line feed is a token of its own there.
        """
        found = list(map(self.ODD.search, words))
        plain = [w for w, odd in zip(words, found) if not odd]
        words = plain + [w for w, odd in zip(words, found) if odd]
        first, last = len(self.number), len(self.number) + len(words)
        self.number.update(zip(words, range(first, last)))
        self.start, self.size = _grown(self.start, last), _grown(self.size, last)
        self.size[first + len(plain):last], self.start[first + len(plain):last] = -1, 0
        for k in range(0, len(plain), WORDS_A_LINE):
            part, at = plain[k:k + WORDS_A_LINE], first + k
            ids = self.library(["".join([w if w[0] == "\n" else "\n " + w for w in part])])[0]
            lines = np.flatnonzero(ids == self.line)
            if len(lines) != len(part):  # never seen; each word by itself is right as well
                each = self.library(["\n" + (w[1:] if w[0] == "\n" else " " + w) for w in part])
                ids = np.concatenate(each)
                lines = np.cumsum([0, *map(len, each)])[:-1]
            own = np.array([w[0] != "\n" for w in part])  # without the line feed
            self.start[at:at + len(part)] = self.used + lines + own
            self.size[at:at + len(part)] = np.diff(lines, append=len(ids)) - own
            self.ids = _grown(self.ids, self.used + len(ids))
            self.ids[self.used:self.used + len(ids)] = ids
            self.used += len(ids)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for one not met."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, the end id behind each, and the number of ids of each text with it."""
        # every text gets a line feed in front, in whose place the end id of the text before stands at last
        marked = pc.binary_join_element_wise(pa.scalar("\n"), pc.replace_substring(texts, "\n", " \n"), pa.scalar(""))
        words = pc.split_pattern(marked, " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self.numbers(distinct)
        new = np.flatnonzero(number < 0)
        if len(self.number) + len(new) > KEPT_WORDS:
            self.forget_rare()
            number = self.numbers(distinct)
            new = np.flatnonzero(number < 0)
        if len(new):
            unknown = [distinct[k] for k in new.tolist()]
            self.learn(unknown)
            number[new] = self.numbers(unknown)
        if len(self.met) < len(self.number):
            self.met = np.append(self.met, np.zeros(2 * len(self.number) - len(self.met), np.int64))
        self.met[number] += 1
        number = number[coded.indices.to_numpy()]
        sizes, first = self.size[number], words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
        whole = np.minimum.reduceat(sizes, first) < 0
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        sizes = np.maximum(sizes, 0)
        flat = _gathered(self.ids, self.start[number], sizes)
        n = np.add.reduceat(sizes, first)
        if not whole.any():
            flat[(np.cumsum(n) - n)[1:]] = END
            return np.append(flat[1:], self.kind.type(END)), n
        at = np.cumsum(n) - n
        end = np.array([END], self.kind)
        given = iter(self.library(texts.filter(pa.array(whole)).to_pylist()))
        parts = [np.append(next(given) if w else flat[a + 1:a + k], end) for w, a, k in zip(whole, at.tolist(), n.tolist())]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _gathered(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``x`` of so many entries from each start, end to end."""
    ends = np.cumsum(size)
    return x[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, or a copy twice as long and more, with room for ``n``."""
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n, 2 * len(x)) - len(x), x.dtype)])


def _texts(column: pa.Array) -> pa.Array:
    """Texts without nulls; bytes that are no UTF-8 are replaced."""
    column = column.fill_null("")
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        column = pa.array([t.decode("utf-8", "replace") for t in raw(column)], pa.string())
    return column


def _slices(column: pa.Array, chars: int):
    """Slices of about so many bytes, a text at least."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    k = 0
    while k < len(column):
        done = int(ends[k - 1]) if k else 0
        n = max(1, int(np.searchsorted(ends, done + chars, side="right")) - k)
        yield column.slice(k, n)
        k += n


def encoder(path: str) -> Encoder:
    """The encoder of a worker, with the words it has met."""
    return kept(("encoder", path), lambda: Encoder(path))


def _commit(fs: pafs.FileSystem, path: str, write) -> None:
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as sink:
        write(sink)
    fs.move(draft, path)


class Rows:
    """Writes a stream of ids as fixed-size rows with masks."""

    def __init__(self, sink, length: int, rows: int, kind: np.dtype):
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = ipc.new_file(sink, self.schema)
        self.length, self.rows, self.left = length, rows, np.empty(0, kind)

    def add(self, ids: np.ndarray) -> None:
        self.left = np.concatenate([self.left, ids])
        whole = self.length * self.rows
        for k in range(len(self.left) // whole):
            self._write(self.left[k * whole:(k + 1) * whole], whole)
        self.left = self.left[len(self.left) // whole * whole:]

    def _write(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        self.writer.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        n = len(self.left)
        if n:
            self._write(np.concatenate([self.left, np.full(-n % self.length, END, self.left.dtype)]), n)
        self.writer.close()


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      path: str | None = None, length: int = LENGTH, rows: int = ROWS,
                      chars_a_file: int = CHARS_A_FILE) -> DataFrame:
    """Write all documents below ``folder`` (a path all executors share) in ascending id order.

    Returns one row per file: file, n_docs, n_tokens, start (ids in all files before it). Nulls: a null
    text is empty, a null id comes first. Each document ends with the end id. Repeated rows are written each.
    No documents: no files. Ids may be of any type that Spark orders. ``path`` is the vocabulary, the
    byte-level one of the public package unless given.
    """
    path = path or vocabulary()
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col) + 32)).first()[0] or 0
    n_files = int(chars // chars_a_file) + 1
    rows_in = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(n_files, F.asc_nulls_first("id"), "tie")
               .sortWithinPartitions(F.asc_nulls_first("id"), "tie", "text"))
    arrow_kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = open_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/tokens-{part:06d}.arrow"
        ids, starts, sizes, at = [], [], [], 0
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        with fs.open_output_stream(draft) as sink:
            made = encoder(path)
            out = Rows(sink, length, rows, made.kind)
            for batch in batches:
                for texts in _slices(_texts(batch.column(1)), BYTES_AT_ONCE):
                    flat, n = made.encode(texts)
                    starts.append(at + np.cumsum(n) - n)
                    sizes.append(n)
                    at += len(flat)
                    out.add(flat)
                ids.append(batch.column(0))
            out.close()
        if not starts:
            fs.delete_file(draft)
            return
        fs.move(draft, name)
        starts, sizes = np.concatenate(starts), np.concatenate(sizes)
        index = pa.table({"id": pa.chunked_array(ids, arrow_kind), "start": pa.array(starts, pa.int64()),
                          "n_tokens": pa.array(sizes, pa.int64())})
        _commit(fs, f"{base}/index-{part:06d}.arrow",
                lambda sink: _write_table(sink, index))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(starts)], pa.int64()),
                                          pa.array([at], pa.int64())], ["file", "n_docs", "n_tokens"])

    made = rows_in.select("id", "text").mapInArrow(run, "file int, n_docs bigint, n_tokens bigint")
    done = spark.createDataFrame(made.collect(), made.schema)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))


def _write_table(sink, table: pa.Table) -> None:
    with ipc.new_file(sink, table.schema) as out:
        out.write_table(table)


class TokenFile:
    """Random access to one data file; rows are views of the mapped file where it is a local one."""

    def __init__(self, folder: str, file: int):
        fs, base = open_uri(folder)
        names = f"{base}/tokens-{file:06d}.arrow", f"{base}/index-{file:06d}.arrow"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.reader = ipc.open_file(pa.memory_map(names[0]) if local else fs.open_input_file(names[0]))
        self.index = ipc.open_file(fs.open_input_file(names[1])).read_all()
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if self.batches else 0
        self._batch = (-1, None)

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids of batch ``k`` as a two-dimensional array, and its masks, one bit an id, end to end."""
        if self._batch[0] != k:
            ids, mask = (c.flatten() for c in self.reader.get_batch(k).columns)
            self._batch = (k, (ids.to_numpy(zero_copy_only=True).reshape(-1, self.length), mask))
        return self._batch[1]

    def row(self, r: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Sequence ``r`` and its mask, both views."""
        ids, mask = self.batch(r // self.rows)
        r %= self.rows
        return ids[r], mask.slice(r * self.length, self.length)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from a position of the stream."""
        size, out = self.rows * self.length, []
        while n > 0:
            ids = self.batch(start // size)[0].reshape(-1)[start % size:start % size + n]
            out.append(ids)
            start, n = start + len(ids), n - len(ids)
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def read_documents(files: DataFrame, folder: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id (of the type ``id_type``, that of the documents), start (over all files), n_tokens, ids_crc32."""
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = TokenFile(folder, file)
                for part in data.index.to_batches(20_000):
                    at, size = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(data.span(a, s).astype("<u4", copy=False).data) for a, s in zip(at.tolist(), size.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array(at + start), pa.array(size), pa.array(crc, pa.int64())],
                        ["id", "start", "n_tokens", "ids_crc32"])

    return (files.select("file", "start").repartition(n, "file")
            .mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
            .withColumnRenamed("id", id_col))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{_shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

"""Operator 2, SentencePiece encoding and decoding, by a streaming Viterbi search.

The state of the search is a boundary of the text together with the piece that ends there. A piece may follow
another only if the two are *compatible*: merging the characters of both by the vocabulary's ranks gives back just
these two. A segmentation is the vocabulary's own one exactly if all its neighbours are compatible, so each boundary
has one surviving backpointer. Only the last max_len boundaries can start a further piece; as soon as the backpointer
paths of all of these meet in one boundary, the ids before it are committed and forgotten. Memory is a window of
max_len boundaries plus what is uncommitted, whatever the text's length.

No piece holds a space mark after another character and none a line feed, so paths always meet before a space mark
that follows other characters and around line feeds. The ids between such boundaries depend on nothing else and are
remembered in a table of bounded size.

Results for special rows: null text has null ids; empty text has no ids; characters without a piece become their
UTF-8 bytes; a text that holds U+2581 itself decodes to a space there (round_trip is false), as in the format.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .tables import read

MARK = "▁"
NONE, OTHER = -1, 1 << 30


class Vocabulary:
    """Ids, ranks and bytes of the pieces of a BPE model file with byte fallback. Small and picklable."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.raw: list[bytes] = []
        self.byte = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.score.append(model.get_score(i))
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.raw.append(piece.replace(MARK, " ").encode())
        self.max_len = max(map(len, self.ids))
        self.text = {i: p for p, i in self.ids.items()}
        #: character -> (id of the piece that ends there or NONE, the same for what may follow, or None)
        self.trie: dict = {}
        for piece, i in self.ids.items():
            branch = self.trie
            for n, c in enumerate(piece, 1):
                at, below = branch.get(c, (NONE, None))
                if n < len(piece) and below is None:
                    below = {}
                branch[c] = (i if n == len(piece) else at, below)
                branch = below
        #: pairs of characters that stand side by side in a piece
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cuts = "\n" not in "".join(self.ids) and all(MARK not in p.lstrip(MARK) for p in self.ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the mark that encoding puts in front is dropped, bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes texts; one for each worker, as it remembers pairs and words."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 400_000) -> None:
        self.v, self.remembered = vocabulary, remembered
        self.pairs: dict[int, bool] = {}
        self.marked: dict[str, tuple[int, ...]] = {}
        self.plain: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """text's characters after all merges: of neighbours that join to a piece the best-ranked, leftmost first."""
        parts, ids, score = list(text), self.v.ids, self.v.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether piece right may follow piece left; OTHER, a character without a piece, stands beside anything."""
        if left == OTHER:
            return True
        if len(self.pairs) >= self.remembered:
            self.pairs.clear()
        a, b = self.v.text[left], self.v.text[right]
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def stream(self, blocks: Iterable[str]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """The text given in blocks, as (text, [(id or OTHER, end in that text)]) as soon as these are certain."""
        root, limit, pairs, compatible = self.v.trie, self.v.max_len, self.pairs, self.compatible
        window = ""  # the text from the last committed boundary on
        last = [OTHER]  # last[i]: the piece that ends at boundary i of the window, or NONE
        back = [0]  # where it starts
        at = 0  # pieces that start before this boundary have been tried
        for block in itertools.chain(blocks, [None]):
            if block is not None:
                window += block
                last += [NONE] * len(block)
                back += [0] * len(block)
            size = len(window)
            stop = size if block is None else size - limit
            while at < stop:
                before, key, branch, end = last[at], last[at] << 32, root, at
                while end < size:
                    step = branch.get(window[end])
                    end += 1
                    if step is None:
                        if end == at + 1:
                            last[end], back[end] = OTHER, at
                        break
                    piece, branch = step
                    if piece >= 0 and last[end] == NONE:
                        fits = pairs.get(key | piece)
                        if fits is None:
                            fits = compatible(before, piece)
                        if fits:
                            last[end], back[end] = piece, at
                    if branch is None:
                        break
                at += 1
            if block is not None and at >= 4 * limit:
                # paths from all boundaries that a further piece can follow, traced back until they meet
                live = {at, *(e for e in range(at + 1, min(at + limit, size) + 1) if last[e] != NONE)}
                while len(live) > 1:
                    far = max(live)
                    live.remove(far)
                    live.add(back[far])
                meet = live.pop()
                if meet:
                    yield window[:meet], self._path(last, back, meet)
                    window, last, back, at = window[meet:], last[meet:], [max(0, x - meet) for x in back[meet:]], at - meet
        yield window, self._path(last, back, len(window))

    @staticmethod
    def _path(last: list[int], back: list[int], end: int) -> list[tuple[int, int]]:
        out = []
        while end > 0:
            out.append((last[end], end))
            end = back[end]
        return out[::-1]

    def _ids(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for part, path in self.stream([text] if len(text) <= 64 else (text[i : i + 256] for i in range(0, len(text), 256))):
            for piece, end in path:
                if piece == OTHER:
                    out.extend(self.v.byte[b] for b in part[end - 1].encode())
                else:
                    out.append(piece)
        return tuple(out)

    def _part(self, table: dict[str, tuple[int, ...]], key: str, lead: str) -> tuple[int, ...]:
        """The ids of lead + key, remembered by key. Marks at a word's end are cut wherever no piece holds both neighbours,
        and the parts go by themselves."""
        cut, start, inner = len(key), 0, self.v.inner
        while cut > 1 and not key[cut - 1].isalnum():
            cut -= 1
        found: list[tuple[int, ...]] = []
        for i in range(cut, len(key) + 1):
            if i == len(key) or key[i - 1 : i + 1] not in inner:
                own, before = (self.plain, "") if start else (table, lead)
                part = key[start:i]
                ids = own.get(part) or self._remember(own, part, self._ids(before + part))
                found.append(ids)
                start = i
        return found[0] if len(found) == 1 else self._remember(table, key, tuple(itertools.chain.from_iterable(found)))

    def _remember(self, table: dict[str, tuple[int, ...]], key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) <= 64:
            if len(table) >= self.remembered:
                table.clear()
            table[key] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.v.cuts or MARK in text:
            return list(self._ids(MARK + text.replace(" ", MARK)))
        out: list[int] = []
        extend, marked, plain = out.extend, self.marked, self.plain
        feed = self.v.byte[10]
        for n, line in enumerate(text.split("\n")):
            spaces, head = 0, n > 0
            if head:
                out.append(feed)
            for word in line.split(" "):
                if head:  # the start of a later line has no mark in front
                    head = False
                    if word:
                        extend(plain.get(word) or self._part(plain, word, ""))
                    continue
                spaces += 1
                if not word:
                    continue
                if spaces == 1:
                    extend(marked.get(word) or self._part(marked, word, MARK))
                else:
                    extend(self._ids(MARK * spaces + word))
                spaces = 0
            if spaces:
                extend(self._ids(MARK * spaces))
        return out


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", n_ids: str = "n_ids", round_trip: str = "round_trip", remembered: int = 400_000) -> DataFrame:
    """docs with the ids of each whole text, their number and whether they decode to the text again.

    remembered: words and pairs that a worker keeps, for speed against memory.
    Input columns with the names of the three new ones are replaced. No shuffle; rows keep their partitions.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(model_path))  # bounded by the vocabulary file
    docs = docs.drop(ids, n_ids, round_trip)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n_ids, T.LongType()), T.StructField(round_trip, T.BooleanType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        encoder = Encoder(v, remembered)
        for whole in batches:
            for begin in range(0, whole.num_rows, 200):
                batch = whole.slice(begin, 200)
                texts = batch.column(at).to_pylist()
                found = [None if t is None else encoder.encode(t) for t in texts]
                new = [
                    pa.array(found, pa.list_(pa.int32())),
                    pa.array([None if f is None else len(f) for f in found], pa.int64()),
                    pa.array([None if f is None else v.decode(f) == t for f, t in zip(found, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text of each row's ids in column text; null ids give null."""
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(model_path))
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 200):
                batch = whole.slice(begin, 200)
                texts = [None if x is None else vocabulary.value.decode(x) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of every document."""
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model_path()).drop("text")

"""SentencePiece encoding and decoding over a relational lattice.

A text is escaped (blanks become U+2581, one is put in front) and parted into words where no piece
can cross. For the words of a dictionary - the most frequent ones of the whole table - all
substrings up to the longest piece are exploded and joined with the piece table; the edges of a
word are grouped and folded into its best segmentation (Viterbi) with a higher-order aggregate.
Tasks look the words of their texts up there; for a word that is not in the dictionary they fold
the same recurrence over its own edges, so every word gets the same pieces either way."""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreview.llm.common import free_names, text_or_empty
from docreview.session import stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Where no piece crosses, words end: at tabs and line ends, before U+2581 after another character,
#: and between a letter and an ASCII sign or digit. The model is checked for it.
WORD = re.compile(r"[\t\n]|▁*[^\W\d_²]+(?=[!-@\[-^`{-~▁\t\n]|\Z)|▁+[^▁\t\n]*|[^▁\t\n]+")
CROSSING = re.compile(r"[\t\n]|[^▁]▁|[^\W\d_²][!-@\[-^`{-~]")
#: Words in the dictionary and their longest length: with their ids under 30 MB in a task.
DICTIONARY = 100_000
LONGEST = 64
#: Further parts of texts that a task remembers, and parts that a task counts before it sends the counts.
REMEMBERED = 300_000
COUNTED = 200_000
#: Rows that a task encodes or decodes at a time.
ROWS = 200
#: The score of a character that is no piece; it is spelled in bytes.
UNKNOWN = -1e3
#: The lattice adds log probabilities. Models of merges have ranks in their place; the law of Zipf
#: and Mandelbrot turns rank r into -ln(r + offset), up to a constant.
RANK_OFFSET = 100
FIELDS = "piece string, id int, score double"


class Pieces:
    """The piece table of a model file, read on the driver.

    `offset` turns ranks into scores; with None the scores of the file hold (a unigram model)."""

    def __init__(self, path: str = MODEL, offset: float | None = RANK_OFFSET):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.size = len(ids)
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        special = {i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        plain = [i for i in ids if i not in special]
        self.scores = {
            model.id_to_piece(i): (i, model.get_score(i) if offset is None else -math.log(rank + offset))
            for rank, i in enumerate(plain)
        }
        self.longest = max(map(len, self.scores))
        #: Every ending of a piece, with the piece that it is, if any.
        self.endings = {p[n:]: None for p in self.scores for n in range(1, len(p))} | self.scores
        for piece in self.scores:
            if CROSSING.search(piece):
                raise ValueError(f"the piece {piece!r} crosses the ends of words")
        if len(self.bytes) != 256:
            raise ValueError("the model has no pieces for all bytes")
        spelled = {i: bytes([b]) for b, i in self.bytes.items()}
        spelled |= {i: piece.replace(SPACE, " ").encode() for piece, (i, _) in self.scores.items()}
        self.spelled = [spelled.get(i, b"") for i in ids]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i, float(s)) for p, (i, s) in self.scores.items()], FIELDS)


def escape(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def tokens_of(text: str) -> list[str] | None:
    """The parts between blanks, each of which stands for U+2581 and itself; None if there are
    blanks in a row or U+2581 in the text, where words may reach over a blank."""
    return None if "  " in text or SPACE in text or text[-1:] in ("", " ") or text[:1] == " " else text.split(" ")


#: Characters at the start of a word whose best scores a task remembers, and for how many starts.
HEAD, HEADS = 6, 20_000


def fold(word: str, endings: dict[str, tuple[int, float] | None], spell: dict[int, int], heads: dict | None = None) -> list[int]:
    """The best pieces of a word: the recurrence of `best_pieces` for one word.

    The best scores up to a place depend on the characters before it only, so words that start
    alike can share them through `heads`."""
    n = len(word)
    known = heads.get(word[:HEAD]) if heads is not None and n > HEAD else None
    best, starts, pieces = map(list, known) if known else ([0.0], [0], [-1])
    get, upto = endings.get, len(best)
    for end in range(upto, n + 1):
        top, came, piece, single = -math.inf, end - 1, -1, False
        for start in range(end - 1, -1, -1):
            edge = get(word[start:end], False)
            if edge is False:
                break
            if edge is not None:
                single = single or start == end - 1
                score = best[start] + edge[1]
                if score >= top:  # of equal scores the edge that starts first
                    top, came, piece = score, start, edge[0]
        if not single and best[end - 1] + UNKNOWN > top:
            top, came, piece = best[end - 1] + UNKNOWN, end - 1, -1
        best.append(top)
        starts.append(came)
        pieces.append(piece)
        if end == HEAD and heads is not None and n > HEAD:
            if len(heads) >= HEADS:
                heads.clear()
            heads[word[:HEAD]] = tuple(best), tuple(starts), tuple(pieces)
    ids: list[int] = []
    while n:
        start, piece = starts[n], pieces[n]
        if piece >= 0:
            ids.append(piece)
        else:
            ids.extend(spell[b] for b in reversed(word[start:n].encode("utf-8", "surrogatepass")))
        n = start
    return ids[::-1]


# ---- the dictionary, relationally --------------------------------------------------------------


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over the whole texts; words over LONGEST characters are left to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: Counter[str] = Counter()
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            for part, n in parts.items():
                for word in WORD.findall(SPACE + part):
                    counts[word] += n
            words = [w for w in counts if len(w) <= LONGEST]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"]
            )
            parts.clear()
            counts.clear()
            return batch

        for batch in batches:
            for t in map(pa.StringScalar.as_py, batch.column(0)):
                split = tokens_of(t)
                if split is None:
                    counts.update(WORD.findall(escape(t)))
                else:
                    parts.update(split)
                if len(parts) + len(counts) > COUNTED:
                    yield rows()
        yield rows()

    counted = df.select(text_or_empty(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int = DICTIONARY) -> DataFrame:
    """The words that occur at least 2**k times, for the least k that leaves `limit` words."""
    sizes = {
        r["k"]: r["words"]
        for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("words")).collect()
    }
    k = max(sizes, default=0) + 1
    total = 0
    while k > 0 and total + sizes.get(k - 1, 0) <= limit:
        k -= 1
        total += sizes.get(k, 0)
    return counts.where(F.col("n") >= F.lit(2**k)).select("word")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges): every substring that is a piece, as (end, start, score, id).

    The piece table is as large as the model's vocabulary and so broadcast."""
    n = F.char_length("word")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - i)),
            lambda k: F.struct((i + k).alias("end"), i.alias("start"), F.substring(F.col("word"), i + 1, k).alias("piece")),
        ),
    ))
    substrings = words.select("word", F.explode(spans).alias("s")).select("word", "s.*")
    edges = substrings.join(F.broadcast(pieces.table(words.sparkSession)), "piece")
    return words.join(
        edges.groupBy("word").agg(F.collect_list(F.struct("end", "start", "score", "id")).alias("edges")), "word", "left"
    ).withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<end:int,start:int,score:double,id:int>>")))


def best_pieces(word: Column, edges: Column, pieces: Pieces) -> Column:
    """The ids of the best segmentation, by folding over the ends of the edges from left to right.

    The state has for each place the best score up to it, and the edge it came by; of equal scores
    the edge that starts first is taken. A character without a piece of its own costs UNKNOWN and
    is spelled in bytes."""
    n = F.char_length(word)
    step = "struct<score:double,back:int,start:int,id:int>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(0).alias("start"), F.lit(-1).alias("id"))).cast(f"array<{step}>")

    def arrive(states, end):
        own = F.filter(edges, lambda e: e["end"] == end)
        ways = F.transform(own, lambda e: F.struct(
            (F.element_at(states, e["start"] + 1)["score"] + e["score"]).alias("score"),
            (-e["start"]).alias("back"), e["start"].alias("start"), e["id"].alias("id"),
        ))
        spelled = F.struct(
            (F.element_at(states, end)["score"] + F.lit(UNKNOWN)).alias("score"),
            (1 - end).alias("back"), (end - 1).alias("start"), F.lit(-1).alias("id"),
        )
        single = F.exists(own, lambda e: e["start"] == end - 1)
        options = F.concat(ways, F.when(single, F.array().cast(f"array<{step}>")).otherwise(F.array(spelled).cast(f"array<{step}>")))
        return F.concat(states, F.array(F.array_max(options)))

    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    states = F.aggregate(places, first, arrive)
    table = F.array(*[F.lit(pieces.bytes[b]) for b in range(256)])

    def spell(end):
        code = F.hex(F.encode(F.substring(word, end, F.lit(1)), "UTF-8"))
        return F.transform(
            F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")),
            lambda i: F.element_at(table, F.conv(F.substring(code, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + 1),
        )

    def leave(walk, end):
        state = F.element_at(walk["states"], end + 1)
        ids = F.when(state["id"] >= 0, F.array(state["id"])).otherwise(spell(end))
        here = walk["at"] == end
        return F.struct(
            F.when(here, state["start"]).otherwise(walk["at"]).alias("at"),
            F.when(here, F.concat(ids, walk["ids"])).otherwise(walk["ids"]).alias("ids"),
            walk["states"].alias("states"),
        )

    back = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"), states.alias("states"))
    return F.aggregate(F.reverse(places), back, leave, lambda walk: walk["ids"])


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word) -> (word, ids)."""
    return lattice(words, pieces).select("word", best_pieces(F.col("word"), F.col("edges"), pieces).alias("ids"))


# ---- texts -------------------------------------------------------------------------------------


class _Encoded(dict):
    """Ids as bytes of the parts of a text between blanks, the first ones remembered. Their words are
    looked up in the dictionary; those that it lacks are folded."""

    def __init__(self, words: dict[str, bytes], endings, spell):
        super().__init__()
        self.words, self.endings, self.spell, self.heads = words, endings, spell, {}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        return np.array(fold(word, self.endings, self.spell, self.heads), np.int32).tobytes() if ids is None else ids

    def __missing__(self, part: str) -> bytes:
        ids = b"".join(map(self.word, WORD.findall(SPACE + part)))
        if len(self) < REMEMBERED:  # frequent parts come early
            self[part] = ids
        return ids

    def text(self, text: str) -> bytes:
        split = tokens_of(text)
        if split is None:
            return b"".join(map(self.word, WORD.findall(escape(text))))
        return b"".join([self[part] for part in split])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _encoder(df: DataFrame, text: str, pieces: Pieces, limit: int):
    """What `_Encoded` needs, as a broadcast: the dictionary of the whole table and the pieces."""
    words = frequent_words(stage(word_counts(df, text)), limit)
    known = {
        r["word"]: np.array(r["ids"], np.int32).tobytes() for r in stage(encode_words(words, pieces)).toLocalIterator()
    }
    return df.sparkSession.sparkContext.broadcast((known, pieces.endings, pieces.bytes))


def _lists(blobs: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(b) // 4 for b in blobs]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def _spell(codes: np.ndarray, parts: np.ndarray) -> bytes:
    """What pieces spell, without the blank that `escape` puts in front."""
    whole = b"".join(parts[codes].tolist())
    return whole[1:] if whole.startswith(b" ") else whole


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL, limit: int = DICTIONARY) -> DataFrame:
    """`df` with a column `ids` (array of int): the pieces of the whole text, in sequence.

    Of equally good segmentations the one whose last differing piece starts first is taken. A null
    or empty text has no pieces. A column that is named like `ids` is replaced, others stay as they
    are; repeated rows give repeated rows; an empty table gives no rows. The texts are read twice
    and shuffled nowhere: first words are counted, over the whole table. The dictionary is bounded,
    so it is collected and broadcast; other words are exact too."""
    shared = _encoder(df, text, Pieces(model), limit)
    rest = [c for c in df.columns if c != ids]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = _Encoded(*shared.value)
        for batch in _portions(batches):
            blobs = [encoded.text(t.as_py()) for t in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], _lists(blobs)], schema.names)

    (whole,) = free_names(df, "_text")
    return df.select(*rest, text_or_empty(text).alias(whole)).mapInArrow(run, schema)


def encode_and_check(
    df: DataFrame, keep: list[str], text: str = "text", model: str = MODEL, limit: int = DICTIONARY
) -> DataFrame:
    """The columns `keep`, then ids as `encode` gives them, decoded_sha256 (of what `decode` gives
    for these ids, in UTF-8) and round_trip: whether that is the text with blanks for U+2581.

    One pass encodes, decodes the ids through the piece table and compares; texts do not come back
    from it. Null and empty texts have no pieces and agree. Names of `keep` must not be those of
    the new columns; repeated rows give repeated rows, an empty table none."""
    pieces = Pieces(model)
    shared = _encoder(df, text, pieces, limit)
    spelled = df.sparkSession.sparkContext.broadcast(pieces.spelled)
    schema = T.StructType([
        *[df.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, parts = _Encoded(*shared.value), np.array(spelled.value, object)
        for batch in _portions(batches):
            blobs, digests, agree = [], [], []
            for scalar in batch.column(len(keep)):
                t = scalar.as_py()
                blobs.append(encoded.text(t))
                whole = _spell(np.frombuffer(blobs[-1], np.int32), parts)
                wanted = t.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                agree.append(whole == wanted)
                if not agree[-1]:
                    whole = whole.decode("utf-8", "replace").encode()
                digests.append(hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], _lists(blobs), pa.array(digests, pa.string()), pa.array(agree, pa.bool_())],
                schema.names,
            )

    return df.select(*keep, text_or_empty(text).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """`df` with a column `text`: what the pieces in `ids` spell.

    Null ids give null. Control and unknown pieces spell nothing, bytes that are no UTF-8 the
    replacement character, and ids outside the table are an error. Decoding what was encoded gives
    the text again, except that U+2581 becomes a blank."""
    spelled = df.sparkSession.sparkContext.broadcast(Pieces(model).spelled)
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(text, T.StringType())])
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.array(spelled.value, object)
        for batch in _portions(batches):
            texts = []
            for row in batch.column(at):
                if not row.is_valid:
                    texts.append(None)
                    continue
                codes = row.values.to_numpy(zero_copy_only=False)
                if len(codes) and codes.min() < 0:
                    raise ValueError("an id below 0")
                texts.append(_spell(codes, parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return df.select(*rest).mapInArrow(run, schema)

"""Alignment of two tokenizers' cuts of the same bytes, by skipping along the diagonal.

Each token stands for its end offset. While both cuts go one to one, the two arrays of ends agree at a fixed shift of
their indices, so stretches of doubling length are compared at once and jumped. Where they part, the group there is
worked out by moving on whichever side ends first until both end together, and the shift follows from where that was.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.operators.joins import lookup_join
from gleaner.session import BROADCAST_BYTES, cut_lineage, scratch

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
TEXTS = 64  # texts that are encoded at a time
STRIDE = 4  # the first one along the diagonal
# How the byte-level vocabulary parts a text before its merges.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile(r"[\t\n\r -~\u00a1-\u024f]*")  # letters and digits of these are the same in every version of Unicode
ROW_BYTES = 32  # of a pair and its count, as Spark keeps them
_SHIFT = 1 << 32  # a pair of ids as one number


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from
    256 on in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Cutter:
    """Both tokenizers, with the bytes of each id; `ranks` has the first one's tokens by their merges."""

    tokenizer: Tokenizer
    ranks: tiktoken.Encoding | None
    pieces: sentencepiece.SentencePieceProcessor
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_size: np.ndarray
    b_size: np.ndarray

    def first(self, texts: list[str]) -> list[list[int]]:
        """Ids by the first tokenizer. Where every letter is Latin, its merges are applied by rank, which is the same
        and takes a third of the time."""
        out: list[list[int] | None] = [self.ranks.encode_ordinary(t) if self.ranks and _LATIN.fullmatch(t) else None for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    def cut(self, texts: list[str]) -> list[tuple[list[int], list[int], list[int], list[int]] | None]:
        """Ids and ends of both cuts of each text; None where either does not give back a space and the text."""
        out = []
        for text, a, b in zip(texts, self.first([" " + t for t in texts]), self.pieces.encode(texts, num_threads=1), strict=True):
            whole = (" " + text).encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((a, np.cumsum(self.a_size[a]).tolist(), b, np.cumsum(self.b_size[b]).tolist()) if same else None)
        return out


def _by_rank(content: dict, a_bytes: list[bytes]) -> tiktoken.Encoding | None:
    """The vocabulary's merges by rank, if its ids are in the order of its merges: bytes first, then what each makes."""
    merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
    made = [content["model"]["vocab"].get(x + y) for x, y in merges]
    if made != list(range(256, 256 + len(made))) or any(len(x) != 1 for x in a_bytes[:256]):
        return None
    return tiktoken.Encoding("merges", pat_str=PARTS, mergeable_ranks={x: k for k, x in enumerate(a_bytes[:256 + len(made)])}, special_tokens={})


def load(byte_bpe: str | bytes = BYTE_BPE, pieces: str | bytes = PIECES) -> Cutter:
    """Read a byte-level BPE and a SentencePiece model, from files or their contents."""
    if not isinstance(byte_bpe, bytes):
        with open(byte_bpe, "rb") as file:
            byte_bpe = file.read()
    tokenizer = Tokenizer.from_buffer(byte_bpe)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    model = sentencepiece.SentencePieceProcessor(**{"model_proto" if isinstance(pieces, bytes) else "model_file": pieces})
    letters = byte_letters()
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (n or "" for n in names)]
    n = model.get_piece_size()
    b_bytes = [b"" if model.is_control(i) or model.is_unknown(i) else
               bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
    return Cutter(tokenizer, _by_rank(json.loads(byte_bpe), a_bytes), model, a_bytes, b_bytes, np.array([len(x) for x in a_bytes]), np.array([len(x) for x in b_bytes]))


def stretches(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(tokens of a, tokens of b, times): the groups up to and with each end that both ascending lists of ends hold,
    the last of which they share. A group of one and one is given with how often it follows itself."""
    out: list[tuple[int, int, int]] = []
    i = j = 0
    n = len(a)
    while i < n:
        start, width = i, STRIDE
        while True:  # along the diagonal, by strides that double
            mine, other = a[i:i + width], b[j:j + width]
            if mine != other:  # the last stride is cut where it parts
                for x, y in zip(mine, other):
                    if x != y:
                        break
                    i, j = i + 1, j + 1
                break
            i, j = i + len(mine), j + len(mine)
            if i >= n:
                break
            width *= 2
        if i > start:
            out.append((1, 1, i - start))
        if i >= n:
            break
        p, q = i, j
        x, y = a[p], b[q]
        while x != y:
            if x < y:
                p += 1
                x = a[p]
            else:
                q += 1
                y = b[q]
        out.append((p + 1 - i, q + 1 - j, 1))
        i, j = p + 1, q + 1
    return out


def groups(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Every group by itself: (1, 1), (2, 1) for ends 3, 5, 9 and 3, 9."""
    return [(m, n) for m, n, times in stretches(a, b) for _ in range(times)]


def _digest(a: list[int], b: list[int], found: list[tuple[int, int, int]], a_text: list[str], b_text: list[str]) -> tuple[str, np.ndarray]:
    """The hash of the groups' ids, and the pairs of ids that end together."""
    parts, i, j = [], 0, 0
    a_text, b_text = list(map(a_text.__getitem__, a)), list(map(b_text.__getitem__, b))  # with the sign that follows: 12| and 34;
    for m, n, times in found:
        if m == 1 == n:
            turns = [""] * (2 * times)
            turns[::2], turns[1::2] = a_text[i:i + times], b_text[j:j + times]
            parts += turns
            i, j = i + times, j + times
        else:
            parts.append(",".join(map(str, a[i:i + m])) + "|" + ",".join(map(str, b[j:j + n])) + ";")
            i, j = i + m, j + n
    steps = np.array(found, np.int64)
    last_a, last_b = (np.cumsum(np.repeat(steps[:, c], steps[:, 2])) - 1 for c in (0, 1))
    pairs = np.array(a, np.int64)[last_a] * _SHIFT + np.array(b, np.int64)[last_b]
    return hashlib.sha256("".join(parts)[:-1].encode()).hexdigest(), pairs


_MADE = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pair array<bigint>, times array<bigint>"


def align(docs: DataFrame, text: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, spans: bool = False) -> DataFrame:
    """`docs` with n_a, n_b, n_groups, groups_sha256, and the distinct pairs of ids that end together (`pair`, the
    first tokenizer's id << 32 | the second's) with how often (`times`); with `spans` also the groups themselves, as
    an array of (number of tokens of each).

    Whole texts are cut. A text that is null, empty, or not given back by either tokenizer has no tokens: zeros, an
    empty hash, no pairs. Rows are judged one by one; columns of these names are replaced.
    """
    made = ["n_a", "n_b", "n_groups", "groups_sha256", "pair", "times"] + (["spans"] if spans else [])
    docs = docs.drop(*[c for c in made if c != text])
    with open(byte_bpe, "rb") as one, open(pieces, "rb") as two:
        shared = docs.sparkSession.sparkContext.broadcast((one.read(), two.read()))  # two vocabularies, whatever the corpus
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        cutter = load(*shared.value)
        a_text, b_text = [f"{k}|" for k in range(len(cutter.a_bytes))], [f"{k};" for k in range(len(cutter.b_bytes))]
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(low, TEXTS)
                out: dict[str, list] = {c: [] for c in made}
                for cut in cutter.cut([t or "" for t in batch.column(at).to_pylist()]):
                    a, a_ends, b, b_ends = cut or ([], [], [], [])
                    if not a_ends or not b_ends:
                        a = b = a_ends = b_ends = []
                    found = stretches(a_ends, b_ends)
                    sha, pairs = _digest(a, b, found, a_text, b_text) if found else ("", np.zeros(0, np.int64))
                    pair, times = np.unique(pairs, return_counts=True)
                    for c, v in zip(made, (len(a), len(b), len(pairs), sha, pair, times, found)):
                        out[c].append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                columns = [pa.array(out[c], ty) for c, ty in zip(made, types)]
                if spans:
                    columns.append(pa.array([[{"a": m, "b": n} for m, n, k in g for _ in range(k)] for g in out["spans"]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))))
                schema = batch.schema
                for c, column in zip(made, columns, strict=True):
                    schema = schema.append(pa.field(c, column.type))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=schema)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, {_MADE}" + (", spans array<struct<a:int,b:int>>" if spans else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether that is the most for its second id."""
    each = aligned.select(F.explode(F.arrays_zip("pair", "times")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.times").alias("n"))
    each = each.withColumn("b", F.col("pair").bitwiseAND(_SHIFT - 1))
    most = each.groupBy("b").agg(F.max("n").alias("most"))
    return each.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Alignments are written once; pairs are counted over the corpus and looked up again from there. The counts are
    broadcast if they measure no more than `max_bytes`; beyond that, the most frequent pairs are and the others meet
    theirs in a shuffle. Repeated rows and ids are rows of their own and count each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "alignments")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))
    made = align(rows, "text", byte_bpe, pieces).drop("text")
    made.write.option("compression", "zstd").parquet(folder)
    made = spark.read.schema(made.schema).parquet(folder)
    counts = cut_lineage(pair_counts(made))
    own = ["_row", "id", "n_a", "n_b", "n_groups", "groups_sha256"]
    each = made.select(*own, F.explode_outer(F.arrays_zip("pair", "times")).alias("p")).select(*own, "p.pair", "p.times")
    if counts.count() * ROW_BYTES <= max_bytes:
        each = each.join(F.broadcast(counts), "pair", "left")
    else:
        each = lookup_join(each, counts, "pair", "n", [F.col("_row"), F.col("pair")])
    each = each.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in own[1:]],
        F.coalesce(F.sum("times"), F.lit(0)).alias("n_links"),
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).alias("count_sum"),
    )
    return each.drop("_row")


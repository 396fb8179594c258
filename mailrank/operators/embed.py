"""Embedding jobs: text columns to vectors, token ids, batch model inference, pooling."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.functions.text import blank, fill_blank, strip_ws, with_role
from mailrank.functions.vectors import VECTOR_DIM, hash_embedding, l2_normalise
from mailrank.session import fresh_path

# Fixed values.
BOS, EOS = "<bos>", "<eos>"
UNKNOWN_ID = 1
# Larger vocabularies are joined, not sent to every worker.
VOCAB_ROWS = 2_000_000
VOCAB_BYTES = 64 * 1024 * 1024
RUN_BITS = 12  # rows whose words are joined together, as a power of 2
TOKENS_AT_ONCE = 65_536  # ids a model sees in one call, padding counted,
RUN_BLOCKS = 16  # and as many times that in one output batch

TOKENIZER_JSON = (
    "model STRUCT<vocab: MAP<STRING, BIGINT>>, added_tokens ARRAY<STRUCT<content: STRING, id: BIGINT>>"
)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class BatchEmbedder:
    """A Python embedder. ``factory()`` runs once per Python worker and returns a
    function from a list of texts to one vector per text."""

    factory: Callable[[], Callable[[list[str]], np.ndarray]]
    dim: int = VECTOR_DIM


# An embedder is a column function (text to vector) or a batch embedder.
Embedder = Callable[[Column], Column] | BatchEmbedder


def hash_embedder(dim: int = VECTOR_DIM) -> Callable[[Column], Column]:
    """The deterministic embedder: SHA-256 bytes as a vector."""
    return lambda c: hash_embedding(c, dim)


def embed_column(
    df: DataFrame, text_col: str, embedder: Embedder, out: str = "vec", error: str = "embed_error"
) -> DataFrame:
    """Add a vector column and an error column (null where all went well).

    Blank text gets the zero vector. A text the embedder fails on gets it too, and the
    message of the failure; its row stays.
    """
    if not isinstance(embedder, BatchEmbedder):
        return df.withColumn(out, embedder(F.col(text_col))).withColumn(error, F.lit(None).cast("string"))
    embed = _batch_udf(embedder)
    both = df.withColumn("_embedded", embed(F.when(~blank(F.col(text_col)), F.col(text_col))))
    return both.withColumns(
        {out: F.col("_embedded.vec"), error: F.col("_embedded.error")}
    ).drop("_embedded")


def _batch_udf(embedder: BatchEmbedder):
    dim = embedder.dim

    @F.arrow_udf("vec ARRAY<FLOAT>, error STRING")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = embedder.factory()
        for texts in batches:
            vectors = [None] * len(texts)
            errors: list[str | None] = [None] * len(texts)
            rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            values = texts.to_pylist()
            try:
                for at, vector in zip(rows, model([values[i] for i in rows])):
                    vectors[at] = np.asarray(vector, dtype=np.float32)
            except Exception:
                # One bad text must not cost the batch: find it by going row by row.
                for at in rows:
                    try:
                        vectors[at] = np.asarray(model([values[at]])[0], dtype=np.float32)
                    except Exception as failure:
                        errors[at] = f"{type(failure).__name__}: {failure}"
                        vectors[at] = None
                log.warning("%d texts got the zero vector", sum(e is not None for e in errors))
            zero = np.zeros(dim, dtype=np.float32)
            filled = [zero if v is None else v for v in vectors]
            yield pa.StructArray.from_arrays(
                [pa.array(filled, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                names=["vec", "error"],
            )

    return embed


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id)`` from a tokenizer JSON; a model entry wins over an added token."""
    parsed = (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", TOKENIZER_JSON).alias("j"))
        .select("j.*")
    )
    vocab = parsed.select(F.explode("model.vocab").alias("token", "id"))
    added = parsed.select(F.inline("added_tokens")).select(F.col("content").alias("token"), "id")
    # The first of several added tokens of one name counts.
    added = added.groupBy("token").agg(F.first("id").alias("id"))
    return vocab.unionByName(added.join(vocab, "token", "left_anti"))


def _words(c: Column) -> Column:
    """Lower-cased words between whitespace."""
    text = strip_ws(F.lower(fill_blank(c)))
    return F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def encode_tokens(
    df: DataFrame,
    text_col: str,
    vocab: DataFrame,
    unk: int = UNKNOWN_ID,
    out: str = "ids",
    vocab_rows: int = VOCAB_ROWS,
    vocab_bytes: int = VOCAB_BYTES,
) -> DataFrame:
    """Add the token ids of a text: start mark, one id per word, end mark.

    A vocabulary of at most ``vocab_rows`` tokens and ``vocab_bytes`` goes to the workers,
    where a batch's words are looked up at once and no row moves. A larger one is joined:
    rows are numbered in a written copy, the distinct words of each run of ``1 << RUN_BITS`` rows
    meet the vocabulary in a shuffle, and what is known of a run's words is written to the shared
    folder, where the task that reads the run looks them up. Texts never move, and the folder
    has to be one Arrow reaches. A token listed twice has its smallest id.
    """
    vocab = vocab.groupBy("token").agg(F.min(F.col("id").cast("bigint")).alias("id")).persist()
    n, held, *marks = vocab.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length("token") + 12), F.lit(0)),
        *[F.min(F.when(F.col("token") == m, F.col("id"))) for m in (BOS, EOS)],
    ).first()
    if None in marks:
        vocab.unpersist()
        raise ValueError(f"the vocabulary lacks {BOS} or {EOS}")
    bos, eos = (F.array(F.lit(m).cast("bigint")) for m in marks)
    if n <= vocab_rows and held <= vocab_bytes:
        sent = df.sparkSession.sparkContext.broadcast(vocab.toArrow().combine_chunks())
        vocab.unpersist()
        ids = _lookup_udf(sent, unk)(_words(F.col(text_col)))
        return df.withColumn(out, F.concat(bos, ids, eos))
    spark, path, known = df.sparkSession, fresh_path(df.sparkSession, "numbered"), fresh_path(df.sparkSession, "known")
    # Numbers of one task follow one another, so a run of rows lies side by side in the copy.
    df.withColumn("_run", F.shiftright(F.monotonically_increasing_id(), RUN_BITS)).write.parquet(path)
    df = spark.read.parquet(path)
    words = df.select("_run", F.explode(F.array_distinct(_words(F.col(text_col)))).alias("token")).distinct()
    words.join(vocab, "token").hint("rebalance", "_run").write.partitionBy("_run").parquet(known)
    vocab.unpersist()
    ids = _stored_lookup_udf(known, unk)("_run", _words(F.col(text_col)))
    return df.withColumn(out, F.concat(bos, ids, eos)).drop("_run")


def _looked_up(words: pa.Array, tokens: pa.Array, token_ids: pa.Array, unk: int) -> pa.Array:
    """Lists of words as lists of ids."""
    flat = words.flatten()
    at = pc.index_in(flat, value_set=tokens.cast(flat.type))
    ids = pc.fill_null(token_ids.take(at), pa.scalar(unk, pa.int64()))
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), ids)


def _lookup_udf(sent, unk: int):
    @F.arrow_udf("array<bigint>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = sent.value
        tokens = table["token"].combine_chunks()
        token_ids = table["id"].combine_chunks()
        for words in batches:
            yield _looked_up(words, tokens, token_ids, unk)

    return lookup


def _stored_lookup_udf(path: str, unk: int):
    """Ids from the tables below ``path``, one folder for each run of rows; a worker holds one run's."""

    @F.arrow_udf("array<bigint>")
    def lookup(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        system, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)

        def table(run: int) -> pa.Table:
            parts = [pa.table({"token": pa.array([], pa.string()), "id": pa.array([], pa.int64())})]
            for info in system.get_file_info(fs.FileSelector(f"{root}/_run={run}", allow_not_found=True)):
                if info.is_file and info.path.endswith(".parquet"):
                    with system.open_input_file(info.path) as file:
                        parts.append(pq.ParquetFile(file).read(["token", "id"]).cast(parts[0].schema))
            return pa.concat_tables(parts).combine_chunks()

        held = None
        for runs, words in batches:
            numbers = runs.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else []
            done = [pa.array([], pa.list_(pa.int64()))]
            for start, end in zip(starts, [*starts[1:], len(numbers)]):
                if held is None or held[0] != numbers[start]:
                    found = table(numbers[start])
                    held = numbers[start], found["token"].combine_chunks(), found["id"].combine_chunks()
                done.append(_looked_up(words.slice(start, end - start), held[1], held[2], unk))
            yield pa.concat_arrays([a.cast(done[0].type) for a in done])

    return lookup


def model_embed(
    df: DataFrame,
    ids_col: str,
    model_factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    out: str = "vec",
    pool: bool = True,
    tokens_at_once: int = TOKENS_AT_ONCE,
) -> DataFrame:
    """Run a model over token ids; one row in, one row out.

    ``model_factory()`` runs once per Python worker. The model takes ids and a mask, both
    ``(rows, length)``, and returns ``(rows, length, size)``; ``(length, size)`` is taken too,
    from models that know one row only. The mask is 1 at a row's own ids and 0 behind them,
    where ids are 0; what the model gives there is left out. Rows of an Arrow batch are
    sorted by length and run in blocks of at most ``tokens_at_once`` ids, padding counted
    (one longer row is a block). With ``pool`` the mean over tokens is returned, scaled to
    unit length, else the token vectors. A row of null ids gives null; without ids it gives
    null when pooled, else an empty list.
    """
    result = "array<float>" if pool else "array<array<float>>"

    @F.arrow_udf(result)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_factory()
        for batch in batches:
            for ids in _runs_of_tokens(batch, RUN_BLOCKS * tokens_at_once):
                yield (_pooled if pool else _per_token)(model, ids, tokens_at_once)

    embedded = df.withColumn(out, run(F.col(ids_col)))
    return embedded.withColumn(out, l2_normalise(F.col(out))) if pool else embedded


def _lengths(ids: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs_of_tokens(ids: pa.Array, at_most: int) -> Iterator[pa.Array]:
    """A column cut into runs of rows with at most so many ids, or one longer row."""
    ends = np.cumsum(_lengths(ids))
    start = 0
    while start < len(ids):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + at_most, side="right")))
        yield ids.slice(start, end - start)
        start = end
    if not len(ids):
        yield ids


def _blocks(ids: pa.Array, tokens_at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, block, mask, places)`` of rows of like length; ``places`` is where their ids stand in the column."""
    sizes = _lengths(ids)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = len(order)
    while at:  # from the longest down: the first row of a block sets its width
        width = int(sizes[order[at - 1]])
        rows = order[max(0, at - max(1, tokens_at_once // width)) : at]
        at -= len(rows)
        real = np.arange(width) < sizes[rows, None]
        places = (starts[rows, None] + np.arange(width))[real]
        block = np.zeros(real.shape, np.int64)
        block[real] = flat[places]
        yield rows, block, real, places


def _token_vectors(model, block: np.ndarray, real: np.ndarray) -> np.ndarray:
    """``(rows, length, size)``, zero behind each row's own ids."""
    mask = real.astype(np.int64)
    found = np.asarray(model(block, mask), dtype=np.float32)
    if found.ndim == 3 and len(found) == len(block):
        return np.where(real[:, :, None], found, np.float32(0))
    # A model for single rows, 2-D output or a batch of one, sees each row without padding.
    whole = None
    for i, n in enumerate(mask.sum(axis=1)):
        row = np.asarray(model(block[i : i + 1, :n], mask[i : i + 1, :n]), dtype=np.float32)
        row = row[0] if row.ndim == 3 else row
        if whole is None:
            whole = np.zeros((*block.shape, row.shape[1]), np.float32)
        whole[i, :n] = row
    return whole


def _lists(ends: np.ndarray, values: pa.Array, missing: np.ndarray) -> pa.ListArray:
    """Lists that end at ``ends``, null where ``missing``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), values)


def _pooled(model, ids: pa.Array, tokens_at_once: int) -> pa.Array:
    sizes, means = _lengths(ids), None
    for rows, block, real, _ in _blocks(ids, tokens_at_once):
        found = _token_vectors(model, block, real).sum(axis=1, dtype=np.float64) / sizes[rows, None]
        if means is None:
            means = np.zeros((len(ids), found.shape[1]), np.float32)
        means[rows] = found
    if means is None:
        return pa.nulls(len(ids), pa.list_(pa.float32()))
    held = sizes > 0
    return _lists(np.cumsum(held * means.shape[1]), pa.array(means[held].ravel()), ~held)


def _per_token(model, ids: pa.Array, tokens_at_once: int) -> pa.Array:
    sizes, vectors = _lengths(ids), np.zeros((0, 0), np.float32)
    for _, block, real, places in _blocks(ids, tokens_at_once):
        found = _token_vectors(model, block, real)
        if not len(vectors):
            vectors = np.zeros((int(sizes.sum()), found.shape[2]), np.float32)
        vectors[places] = found[real]
    inner = _lists(np.arange(1, len(vectors) + 1) * vectors.shape[1], pa.array(vectors.ravel()), np.zeros(len(vectors), bool))
    return _lists(np.cumsum(sizes), inner, ids.is_null().to_numpy(zero_copy_only=False))


def mean_pool(df: DataFrame, id_cols: list[str], vec_col: str = "vec", out: str = "vec") -> DataFrame:
    """Mean vector per group; partial sums are merged, so a large group is no large task."""
    mean = Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>")))
    return df.groupBy(*id_cols).agg(mean.alias("_mean")).select(
        *id_cols, vector_to_array("_mean").alias(out)
    )


def mean_pool_tokens(tokens: Column, dim: int = VECTOR_DIM) -> Column:
    """Mean of an in-row ``array<array<float>>``; no tokens give the zero vector."""
    total = F.aggregate(
        tokens,
        F.array_repeat(F.lit(0.0), F.size(F.get(tokens, F.lit(0)))),
        lambda acc, v: F.zip_with(acc, v, lambda a, x: a + x.cast("double")),
        lambda acc: F.transform(acc, lambda x: x / F.size(tokens)),
    )
    return F.when(F.size(tokens) > 0, total).otherwise(F.array_repeat(F.lit(0.0), dim))


def dim_report(vectors: DataFrame, expected: int = VECTOR_DIM, vec_col: str = "vec") -> DataFrame:
    """``(dim, n_vectors, mismatch)``: how long the vectors are."""
    return (
        vectors.groupBy(F.size(vec_col).alias("dim"))
        .agg(F.count(F.lit(1)).alias("n_vectors"))
        .withColumn("mismatch", F.col("dim") != expected)
    )


def query_vectors(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """``(qid, vec)`` of the queries that have a text."""
    asked = queries.where(~blank(F.col("query_text"))).select(
        "qid", with_role(F.col("query_text"), "query").alias("_text")
    )
    return embed_column(asked, "_text", embedder).select("qid", "vec")

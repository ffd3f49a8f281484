"""A training corpus from raw documents: five stages, each by one of the corpus operators.

Language identification rejects what has no language, near duplicates leave one document of each group, repeated
passages are cut out, the sources are mixed to their targets, and the mix is encoded for training.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import common, op03_suffix, op04_langid, op05_mix, op06_bpe, op07_minhash
from emberline.storage import collected, discard, materialize, remove


#: Text bytes that a task of the last stage holds: less than the operator alone takes, as the stages share executors.
CHUNK_BYTES = 4 << 20


#: Tables that the stage before has made on its way, where stages are called one by one: for each folder of input.
_LAST: dict[str, list[str]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the intermediate tables of the stage before it on the same folder: its result has been
    written since, unless ``docs`` still reads them. ``run`` calls the bare stage and keeps its own account."""

    @wraps(f)
    def one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        last = _LAST.pop(sf_dir, [])
        read = docs.inputFiles() if last else []
        if any(name in x for x in read for name in {p.rsplit("/", 1)[-1] for p in last}):
            _LAST[sf_dir] = last
        else:
            remove(spark, last)
        with collected() as made:
            out = f(spark, docs, sf_dir)
        _LAST.setdefault(sf_dir, []).extend(made)
        return out

    return one


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: only ``und`` goes, texts of several languages stay."""
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "lang")  # no column can clash with the new ones
    found = op04_langid.identify(boxed, op04_langid.learn(boxed), ("_row",))
    return found.where(F.col("lang_pred") != op04_langid.UNKNOWN).select("_row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, and of equal ids the one whose text
    has the smallest hash. A document is known by id and text, so unlike texts that share an id, or have none, go only if
    they are linked; rows equal in both are one document. Texts without words have no links."""
    text = F.coalesce("text", F.lit(""))
    number = F.coalesce(F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 21, "0"), F.lit("~"))
    key = F.concat_ws("-", number, F.md5(text.cast("binary")), F.when(F.col("text").isNull(), "null"))
    rest = [F.col(c) for c in docs.columns if c != "text"]
    keyed = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row"), F.to_json(F.struct(*rest)).alias("_rest"), F.col("text").alias("_text"))
    found = op07_minhash.near_duplicates(keyed, id_col="_key", text_col="_text")
    kept = found.where("kept").select("_key").distinct()
    one = keyed.groupBy("_key").agg(F.min_by("_row", "_rest").alias("_row"))  # equal rows meet before they are shuffled
    return one.join(kept, "_key", "left_semi").select("_row.*")


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur twice; what a cut leaves of a character goes with it."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    boxed = docs.select(F.struct(*rest).alias("_row"), "text")
    out = op03_suffix.with_text(op03_suffix.remove_repeats(boxed, carry=("_row",)))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' words at their targets: documents are repeated, cut or left out as their shard's quota says."""
    return op05_mix.mixed(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digest of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = op06_bpe.decode(op06_bpe.encode(docs, path, public_tokenizers.PATTERN, chunk_bytes=CHUNK_BYTES), path)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Learnt languages, bands of registers and merges have no SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the table ``documents``, each written and read again before the next; what a stage has made on
    its way is deleted once its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with collected() as made:
            before, docs = docs, stage.__wrapped__(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = materialize(docs, name)
        if k + 1 < len(STAGES):
            remove(spark, [p for p in made if p != docs._table])
            if k:
                discard(before)
    return docs

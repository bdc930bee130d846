"""Re-indexing of what changed, in batches and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import change_hash
from quern.operators.index import postings
from quern.sources.store import Store, upsert


def changed(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """New rows whose key is unknown or whose digest differs; null counts as a value."""
    known = old.select(*keys, F.col(digest).alias("_old"), F.lit(True).alias("_known"))
    joined = new.join(known, keys, "left")
    return joined.where(F.col("_known").isNull() | ~F.col("_old").eqNullSafe(F.col(digest))).drop("_old", "_known")


def removed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti")


def postings_delta(index: DataFrame, updates: DataFrame, id_col: str, text: str) -> DataFrame:
    """An index in which the slices of updated documents are replaced; a null text takes a document out."""
    fresh = postings(updates.where(F.col(text).isNotNull()), id_col, F.col(text))
    return index.join(updates.select(F.col(id_col).alias("id")).distinct(), "id", "left_anti").unionByName(fresh)


PARTS = 16


def index_stream(documents: DataFrame, store: Store, checkpoint: str, id_col: str = "id", text: str = "text", order: str = "indexed_at", parts: int = PARTS) -> StreamingQuery:
    """Keeps the tables ``docs`` and ``postings`` of a store in step with a stream of document versions.

    Both lie in ``parts`` parts by document. Every micro-batch takes the last version of each document, drops
    those whose hash is known, and writes the parts it touches anew, published in one step. A batch that is
    run again changes nothing, so results are exactly once. Files of former states are deleted by age.
    """
    part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")

    def apply(batch: DataFrame, _: int) -> None:
        latest = upsert(batch.limit(0), batch, [id_col], order).withColumn("hash", change_hash(F.coalesce(F.col(text), F.lit(""))))
        latest = latest.withColumn("part", part)
        if not store.has("docs"):
            fresh = postings(latest.where(F.col(text).isNotNull()), id_col, F.col(text)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
            store.publish_parts({"docs": latest, "postings": fresh}, parts)
            return
        touched = sorted(r[0] for r in latest.select("part").distinct().collect())  # one row a part
        docs = store.part("docs", touched)
        fresh = changed(docs, latest, [id_col], "hash")
        if fresh.isEmpty():
            return
        index = postings_delta(store.part("postings", touched).drop("part"), fresh, id_col, text).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        store.publish_parts({"docs": upsert(docs, fresh, [id_col]), "postings": index}, parts, touched)
        store.vacuum()

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def up_to_date(manifest: dict, facts: dict[str, str]) -> bool:
    """Whether a manifest was written for the same pins and versions."""
    return all(manifest.get("facts", {}).get(k) == v for k, v in facts.items())


def pins(known: DataFrame, wanted: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """Wanted builds with ``skip``: whether one of the same key is known with the very same facts, null counting as a value."""
    told = known.select(*keys, F.struct(*facts).alias("_was")).groupBy(*keys).agg(F.collect_set("_was").alias("_was"))
    same = F.coalesce(F.exists("_was", lambda w: w.eqNullSafe(F.struct(*facts))), F.lit(False))
    return wanted.join(told, keys, "left").withColumn("skip", same).drop("_was")

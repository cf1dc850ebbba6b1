"""Input records kept through packing: all fields of each sample's line, whatever they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.config import PackConfig
from packloom.operators.assembly import assign_packs
from packloom.operators.packing import plan_packs


def pack_records(samples: DataFrame, config: PackConfig, record: str = "record") -> DataFrame:
    """``pack_id, records``: the records of each pack's samples in their order, as JSON texts.

    ``samples`` has ``pos``, ``n_tokens`` and the VARIANT column ``record``. A pack has as many records as samples,
    so its list is bounded; a null record stays null.
    """
    rows = samples.select("pos", F.col("n_tokens").cast("long").alias("n_tokens"), F.to_json(record).alias("record"))
    assigned = assign_packs(rows, plan_packs(rows.select("pos", "n_tokens"), config))
    listed = F.sort_array(F.collect_list(F.struct("sample_ord", "record")))
    return assigned.groupBy("pack_id").agg(F.transform(listed, lambda x: x["record"]).alias("records"))

"""Checkpoint splits as Parquet, read them back, report stage shapes.

A checkpoint is a folder with one folder per save, which holds ``train/``, ``test/`` and a
folder per piece of fitted state, and a manifest that names the save to read: format
version, row counts, schemas and the state's scalars. The manifest is put in place last,
by a rename. So a save that is interrupted leaves the checkpoint as it was (or, the first
time, without a manifest, which :func:`load_splits` refuses), and readers never see half
of one. Fitted encoders, scalers and target means are restored with it, to transform new
rows without the training data. Writing also cuts the lineage.
"""

from __future__ import annotations

import json
import uuid
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabprep.errors import CheckpointError
from tabprep.operators.encoding import LabelCodes, Preprocessor
from tabprep.operators.features import TargetMean
from tabprep.splits import Splits

FORMAT = 2
MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    hidden, fs = _fs(spark, f"{root}/manifest-{uuid.uuid4().hex}.json")
    out = fs.create(hidden, True)
    out.write(json.dumps(manifest, sort_keys=True).encode())
    out.close()
    final, _ = _fs(spark, f"{root}/{MANIFEST}")
    jvm = spark.sparkContext._jvm
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(hidden, final, replace)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a checkpoint; refuses a folder without one or of another format."""
    root = path.rstrip("/")
    file, fs = _fs(spark, f"{root}/{MANIFEST}")
    if not fs.exists(file):
        raise CheckpointError(f"{root} has no finished checkpoint")
    found = json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/{MANIFEST}").collect()))
    if found.get("format") != FORMAT:
        raise CheckpointError(f"{root} has format {found.get('format')}, not {FORMAT}")
    return found


def save_splits(splits: Splits, path: str, state: Mapping[str, DataFrame] | None = None,
                spark: SparkSession | None = None, hour_map: TargetMean | None = None,
                prep: Preprocessor | None = None) -> dict:
    """Write both splits and fitted state under ``path``; the checkpoint there is
    replaced once all is written.

    Returns the row counts of both splits, observed during the writes
    themselves (no extra count job).
    """
    spark = spark or splits.train.sparkSession
    root, save = path.rstrip("/"), f"save-{uuid.uuid4().hex[:12]}"
    tables, scalars = dict(state or {}), {}
    if hour_map is not None:
        tables["target_mean"] = hour_map.mapping
        scalars["target_mean"] = {"default": hour_map.default, "n_keys": hour_map.n_keys, "key": hour_map.key,
                                  "value": hour_map.value}
    if prep is not None:
        tables |= {"standard": prep.standard, "minmax": prep.minmax}
        if prep.codes is not None:
            tables["codes"] = prep.codes.codes
            scalars["codes"] = prep.codes.sizes
    counts, schemas = {}, {}
    for name, df in [*splits.items(), *((f"state_{n}", d) for n, d in tables.items())]:
        obs = Observation(f"save_{name}_{save}")
        df.observe(obs, F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{root}/{save}/{name}")
        counts[name], schemas[name] = obs.get["n_rows"], json.loads(df.schema.json())
    _write_manifest(spark, root, {"format": FORMAT, "save": save, "rows": counts, "schemas": schemas, "scalars": scalars})
    return {name: counts[name] for name, _ in splits.items()}


def _table(spark: SparkSession, path: str, manifest: dict, name: str) -> DataFrame:
    if name not in manifest["rows"]:
        raise CheckpointError(f"the checkpoint has no {name}")
    df = spark.read.parquet(f"{path.rstrip('/')}/{manifest['save']}/{name}")
    names = [f["name"] for f in manifest["schemas"][name]["fields"]]
    if df.columns != names or df.count() != manifest["rows"][name]:  # the count comes from the files' footers
        raise CheckpointError(f"{name} of the checkpoint is not what was saved")
    return df


def load_splits(spark: SparkSession, path: str,
                expect_columns: Sequence[str] | None = None) -> Splits:
    """Read a checkpoint written by :func:`save_splits`; verify columns and
    row counts against its manifest (and the expected columns, when given)."""
    manifest = read_manifest(spark, path)
    train, test = (_table(spark, path, manifest, n) for n in ("train", "test"))
    if sorted(train.columns) != sorted(test.columns):
        raise ValueError(
            f"checkpoint splits disagree on columns: {train.columns} vs {test.columns}")
    if expect_columns is not None and sorted(train.columns) != sorted(expect_columns):
        raise ValueError(f"checkpoint columns {train.columns} != expected {list(expect_columns)}")
    return Splits(train, test.select(*train.columns))


def load_state(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _table(spark, path, read_manifest(spark, path), f"state_{name}")


def load_fitted(spark: SparkSession, path: str) -> tuple[TargetMean | None, Preprocessor | None]:
    """The fitted target means and preprocessor of a checkpoint, to transform new rows."""
    manifest = read_manifest(spark, path)
    state, scalars = (lambda n: _table(spark, path, manifest, f"state_{n}")), manifest["scalars"]
    hour_map = TargetMean(state("target_mean"), **scalars["target_mean"]) if "target_mean" in scalars else None
    if "state_standard" not in manifest["rows"]:
        return hour_map, None
    codes = LabelCodes(state("codes"), scalars["codes"]) if "codes" in scalars else None
    return hour_map, Preprocessor(codes, state("standard"), state("minmax"))


def stage_report(stages: Mapping[str, Splits], key: str = "row_id",
                 label: str | None = "arr_delay") -> DataFrame:
    """``stage, split, n_rows, n_cols`` for every stage and split.

    ``n_cols`` counts feature columns (not the key, not the label), as the
    studied pipeline printed the shape of its feature frame. All counts come
    from one job: the frames are projected to two literals and unioned.
    """
    parts = []
    for stage, splits in stages.items():
        for split, df in splits.items():
            n_cols = len([c for c in df.columns if c not in (key, label)])
            parts.append(df.select(F.lit(stage).alias("stage"), F.lit(split).alias("split"),
                                   F.lit(n_cols).cast("int").alias("n_cols")))
    unioned = parts[0]
    for p in parts[1:]:
        unioned = unioned.unionByName(p)
    return (unioned.groupBy("stage", "split", "n_cols")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
            .select("stage", "split", "n_rows", "n_cols"))

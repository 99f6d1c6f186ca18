"""The full cleaning flow (M11) as a fitted plan.

Order (as the reference): standardise names (B1), infer types (C1), coerce
numeric text (C4), fill missing values (D3-D5), detect z-score outliers (E1)
and, if any, remove them sequentially (E3), collapse whitespace (F1), drop
duplicate rows (G1), encode categoricals with the target label-encoded
(H3/H4), add date parts (I1).

``fit`` computes every statistic (one or a few aggregate jobs per step) and
keeps them as literals, the formats of text dates among them; ``transform`` starts no job
and re-applies the same steps to any frame of the same schema, including a streaming one
(``dedupe=False``).  ``save`` and ``load`` keep a fitted plan for another application.
Encoder fitting reads the de-duplicated frame several times, so that frame is
checkpointed once (reliable checkpoint in ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.schema import numeric_columns
from loam.functions.stats import clean_double, safe_z
from loam.operators import columns as COL
from loam.operators import encode as ENC
from loam.operators import features as FE
from loam.operators import missing as MIS
from loam.operators import outliers as OUT
from loam.operators import semantic_types as ST
from loam.operators import text_columns as TXT
from loam.session import materialise, remove, stored

LOG_SCHEMA = "seq int, step string, column_name string, action string, n_affected long, detail string"


@dataclass
class CleaningPlan:
    target: str | None = None
    outlier_threshold: float = 3.0
    encode_threshold: int = 10
    names: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    fills: list[tuple] = field(default_factory=list)
    trim_steps: list[tuple[str, float, float]] = field(default_factory=list)
    date_formats: dict[str, str] = field(default_factory=dict)
    encoding: ENC.EncodingPlan | None = None
    final_target: str | None = None
    log: list[tuple] = field(default_factory=list)

    # ------------------------------------------------------------------ helpers
    def _log(self, step: str, column: str | None, action: str, n: int | None = None, detail: str | None = None):
        self.log.append((len(self.log), step, column, action, None if n is None else int(n), detail))

    def _prepare(self, df: DataFrame) -> DataFrame:
        """B1 + C4 + D: the per-row steps before outlier removal."""
        out = df.toDF(*[self.names.get(c, c) for c in df.columns])
        out = ST.format_numeric_columns(out, self.types)
        return MIS.apply_imputation(out, self.fills)

    def _trim_condition(self) -> Column | None:
        keep = None
        for c, mean, std in self.trim_steps:
            t = F.coalesce(safe_z(clean_double(F.col(c)), F.lit(mean), F.lit(std)) <= self.outlier_threshold,
                           F.lit(True))
            keep = t if keep is None else keep & t
        return keep

    def _finish(self, df: DataFrame) -> DataFrame:
        out = df
        if self.encoding is not None:
            out = self.encoding.transform(out)
        return FE.extract_datetime_features(out, self.types, self.date_formats)

    # ------------------------------------------------------------------ fit
    def fit(self, df: DataFrame) -> tuple["CleaningPlan", DataFrame]:
        """Fit on ``df``; returns the plan and the cleaned frame."""
        self.log = []
        self._log("start", None, "cleaning begins")
        renamed, mapping, new_target = COL.standardize_column_names(df, self.target)
        self.names, self.final_target = mapping, new_target
        self._log("names", None, "column names made uniform")

        self.types, evidence = ST.column_types_with_evidence(renamed)
        self.date_formats = {c: evidence[c]["date_format"] for c, t in self.types.items()
                             if t == "datetime" and evidence[c]["date_format"]}
        for c, t in self.types.items():
            self._log("types", c, "detected type", None, t)
        # evaluated once: fills, outlier statistics and the trimmed rows all read this copy
        coerced, copy = stored(ST.format_numeric_columns(renamed, self.types))

        self.fills = MIS.fit_imputation(coerced, self.types, evidence)
        for c, t, m, s, v in self.fills:
            self._log("missing", c, f"filled with {s}" if s != "none" else "left missing", m,
                      None if v is None else str(v))
        filled = MIS.apply_imputation(coerced, self.fills)

        nums = numeric_columns(filled)
        detected = OUT.detect_outliers(filled, "zscore", self.outlier_threshold, nums).collect()
        n_found = 0
        for r in detected:
            n_found += r["n_outliers"]
            if r["n_outliers"]:
                self._log("outliers", r["column_name"], "detected (zscore)", r["n_outliers"])
        trimmed = filled
        self.trim_steps = []
        # the row count is part of the type evidence: no extra pass
        n_rows = next(iter(evidence.values()))["n_rows"] if evidence else filled.count()
        n_before = n_rows
        if n_found > 0:
            for c in nums:
                mean, std = OUT.mean_std(trimmed, [c])[c]
                self.trim_steps.append((c, mean, std))
                cond = self._trim_condition()
                trimmed = filled.where(cond)
            n_before = trimmed.count()
            self._log("outliers", None, "removed rows (zscore, sequential)", n_rows - n_before)

        texted = TXT.clean_text_columns(trimmed)
        self._log("text", None, "text columns cleaned")
        deduped = materialise(texted.dropDuplicates())
        remove(df.sparkSession, copy)
        n_after = deduped.count()
        n_dupes = n_before - n_after
        if n_dupes:
            self._log("duplicates", None, "duplicate rows dropped", n_dupes)

        self.encoding = ENC.fit_encoding(deduped, self.types, "auto", self.encode_threshold,
                                         target=self.final_target, n_rows=n_after)
        for e in self.encoding.encodings:
            self._log("encode", e.column, f"{e.method} encoding", len(e.output), ",".join(e.output))
        if self.encoding.target:
            self.final_target = self.encoding.target
        cleaned = self._finish(deduped)
        for c, t in self.types.items():
            if t == "datetime":
                self._log("dates", c, "date parts added")
        return self, cleaned

    # ------------------------------------------------------------------ transform
    def transform(self, df: DataFrame, dedupe: bool = True, keep_rows: bool = False) -> DataFrame:
        """Apply the fitted steps lazily (no statistic is recomputed).

        ``keep_rows``: requests to be scored; outliers and repeated rows stay.
        """
        out = self._prepare(df)
        cond = None if keep_rows else self._trim_condition()
        dedupe = dedupe and not keep_rows
        if cond is not None:
            out = out.where(cond)
        out = TXT.clean_text_columns(out)
        if dedupe:
            out = out.dropDuplicates()
        return self._finish(out)

    def save(self, spark: SparkSession, path: str) -> str:
        """One JSON line of names and statistics, and the label codes as Parquet."""
        kept = ("target", "outlier_threshold", "encode_threshold", "names", "types", "fills", "trim_steps", "date_formats",
                "final_target", "log")
        meta = {k: getattr(self, k) for k in kept}
        meta["encoding"] = ENC.save_encodings(self.encoding, f"{path}/codes")
        spark.createDataFrame([(json.dumps(meta, default=float),)], "value string").write.mode("overwrite").text(f"{path}/plan")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CleaningPlan":
        meta = json.loads(spark.read.text(f"{path}/plan").first()[0])
        meta["encoding"] = ENC.load_encodings(spark, meta["encoding"], f"{path}/codes")
        for k in ("fills", "trim_steps", "log"):
            meta[k] = [tuple(x) for x in meta[k]]
        return CleaningPlan(**meta)

    def log_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, LOG_SCHEMA)


def clean_dataset(df: DataFrame, target: str | None = None, threshold: float = 3.0):
    """``(cleaned frame, plan)``."""
    plan, cleaned = CleaningPlan(target=target, outlier_threshold=threshold).fit(df)
    return cleaned, plan

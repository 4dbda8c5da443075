"""Readers and writers by file format; ``load`` and ``save`` go by suffix.

Paths may be in any store that Spark reads.  Every reader takes ``target``: a name or a position, by default the
last column, which is kept last.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.preprocessing import numbered

#: Labels of a column that are kept on the driver and in the plan; beyond, they are joined.
MAX_LABELS = 100_000
MISSING = ("", "na", "nan", "?", "null", "none")


@dataclass
class Dataset:
    """A DataFrame with the names of its features and target and the labels of its nominal columns.

    ``tables`` has ``_kept, _code`` (label and index) for columns with more than ``MAX_LABELS`` labels instead.
    """

    frame: DataFrame
    target: str | None = None
    labels: dict[str, list[str]] = field(default_factory=dict)
    name: str = ""
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [c for c in self.frame.columns if c != self.target]


def number(c: Column) -> Column:
    """A string as a number; missing tokens and other text are null."""
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), F.expr("try_cast(x as double)") if c is None else c.try_cast("double"))


def _target(df: DataFrame, target) -> str | None:
    return target if isinstance(target, str) or target is None else df.columns[target]


def encode(df: DataFrame, target: str | None, handle_categorical: str = "encode") -> Dataset:
    """Text columns become indexes of their sorted values (encode), go (drop), or are an error."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if texts and handle_categorical == "error":
        raise ValueError(f"text columns: {texts}")
    if handle_categorical == "drop":
        return Dataset(df.drop(*[c for c in texts if c != target]), target)
    labels, tables = {}, {}
    for c in texts:
        rows = df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)
        found = [r[0] for r in rows.limit(MAX_LABELS + 1).collect()]
        if len(found) > MAX_LABELS:
            names, tables[c] = df.columns, numbered(rows, c)
            df = df.join(tables[c], F.col(c) == F.col("_kept"), "left").withColumn(c, F.col("_code")).select(*names)
            continue
        labels[c] = found
        df = df.withColumn(c, (F.array_position(F.array(*map(F.lit, labels[c])), F.col(c)) - 1).cast("double") if labels[c] else F.lit(None).cast("double"))
    return Dataset(df, target, labels, tables=tables)


def load_csv(spark: SparkSession, path: str, target=-1, header: bool = True, delimiter: str = ",") -> Dataset:
    raw = spark.read.option("header", header).option("sep", delimiter).csv(path)
    y = _target(raw, target)
    df = raw.select(*[number(F.col(f"`{c}`")).alias(c) if c != y else F.col(f"`{c}`") for c in raw.columns])
    if y and not raw.where(F.col(f"`{y}`").isNotNull() & number(F.col(f"`{y}`")).isNull() & ~F.lower(F.trim(f"`{y}`")).isin(*MISSING)).isEmpty():
        return encode(df, y)
    return Dataset(df.withColumn(y, number(F.col(f"`{y}`"))) if y else df, y)


def save_csv(path: str, df: DataFrame, delimiter: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def _numbers(s: pd.Series) -> pd.Series:
    """As numbers, if all values are."""
    v = pd.to_numeric(s, errors="coerce")
    return v if v.notna().equals(s.notna()) else s


def load_json(spark: SparkSession, path: str, target=-1, orient: str = "auto", lines: bool = False, handle_categorical: str = "encode") -> Dataset:
    """records (an array or one object a line), split, table, index or columns orient."""
    if lines or orient == "records":
        df = spark.read.option("multiLine", not lines).json(path)
        return encode(df, _target(df, target), handle_categorical)
    head = [x[0].strip() for x in spark.read.text(path).limit(2).collect()]
    if orient == "auto" and len(head) == 2 and all(x.startswith("{") and x.endswith("}") for x in head):
        df = spark.read.json(path)  # one object a line
        return encode(df, _target(df, target), handle_categorical)
    df = spark.read.option("multiLine", True).json(path)
    names = set(df.columns)
    if orient in ("auto", "split") and {"columns", "data"} <= names:
        r = df.select("columns", "data").first()
        df = spark.createDataFrame(pd.DataFrame(r["data"], columns=r["columns"]).apply(_numbers))
    elif orient in ("auto", "table") and {"schema", "data"} <= names:
        df = df.select(F.explode("data").alias("r")).select("r.*")
    elif orient == "index" or orient == "auto" and names and all(t.startswith("struct") for _, t in df.dtypes):
        df = df.select(F.explode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("r")).select("r.*")
    return encode(df, _target(df, target), handle_categorical)


def load_jsonl(spark, path, target=-1, handle_categorical="encode", max_lines=None) -> Dataset:
    df = spark.read.json(path)
    df = df.limit(max_lines) if max_lines else df
    return encode(df, _target(df, target), handle_categorical)


def load_json_nested(spark, path, record_path: str, meta=(), target=-1, handle_categorical="encode") -> Dataset:
    """The records of an inner array, each with outer columns."""
    df = spark.read.option("multiLine", True).json(path).select(*[F.col(m) for m in meta], F.explode(record_path).alias("_r")).select("_r.*", *meta)
    return encode(df, _target(df, target), handle_categorical)


def save_jsonl(path, df: DataFrame) -> None:
    df.write.mode("overwrite").json(path)


save_json = save_jsonl


def load_parquet(spark, path, target=-1, columns=None, handle_categorical="encode") -> Dataset:
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return encode(df, _target(df, target), handle_categorical)


def load_parquet_partitioned(spark, path, target=-1, filters=None, handle_categorical="encode") -> Dataset:
    """``filters``: (column, operator, value) tuples or an SQL condition, pushed to the scan."""
    df = spark.read.parquet(path)
    for f in [filters] if isinstance(filters, str) else filters or ():
        df = df.where(f if isinstance(f, str) else {"==": F.col(f[0]) == f[2], "=": F.col(f[0]) == f[2], "!=": F.col(f[0]) != f[2], "<": F.col(f[0]) < f[2], "<=": F.col(f[0]) <= f[2], ">": F.col(f[0]) > f[2], ">=": F.col(f[0]) >= f[2], "in": F.col(f[0]).isin(*(f[2] if f[1] == "in" else ()))}[f[1]])
    return encode(df, _target(df, target), handle_categorical)


def save_parquet(path, df: DataFrame, compression="snappy", partition_by=None) -> None:
    w = df.write.mode("overwrite").option("compression", compression)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


_ATTRIBUTE = re.compile(r"@attribute\s+(?:'([^']+)'|\"([^\"]+)\"|(\S+))\s+(.+)$", re.I)


@dataclass
class Attribute:
    name: str
    kind: str
    values: list[str] = field(default_factory=list)


@dataclass
class ARFFData:
    """A relation: its name, its attributes as declared, and its rows."""

    relation: str
    attributes: list[Attribute]
    frame: DataFrame

    @property
    def nominal(self) -> dict[str, list[str]]:
        return {a.name: a.values for a in self.attributes if a.kind == "nominal"}


def read_arff(spark: SparkSession, path: str) -> ARFFData:
    """A file with its declaration; nominal values are their text."""
    data = load_arff(spark, path)
    head = [_attribute(r[0]) for r in spark.read.text(path).where(F.lower(F.trim("value")).startswith("@attribute")).collect()]
    df = data.frame
    for a in head:
        if a.kind == "nominal":
            df = df.withColumn(a.name, F.element_at(F.array(*map(F.lit, a.values)), F.col(f"`{a.name}`").cast("int") + 1))
    return ARFFData(data.name, head, df)


def _attribute(line: str) -> Attribute:
    m = _ATTRIBUTE.match(line.strip())
    kind = m[4].strip()
    if kind.startswith("{"):
        return Attribute(m[1] or m[2] or m[3], "nominal", [v.strip().strip("'\"") for v in kind.strip("{} ").split(",")])
    return Attribute(m[1] or m[2] or m[3], "numeric" if kind.lower().split()[0] in ("numeric", "real", "integer") else "string")


def load_arff(spark: SparkSession, path: str, target=-1) -> Dataset:
    """Dense and sparse rows; nominal values become their place in the declaration; strings stay text.

    The header is read up to @data; rows are parsed where they lie.
    """
    return _arff(spark.read.text(path), target)


def _arff(lines: DataFrame, target) -> Dataset:
    head = [r[0] for r in lines.where(F.lower(F.trim("value")).startswith("@attribute")).collect()]
    relation = lines.where(F.lower(F.trim("value")).startswith("@relation")).first()
    attrs = [_attribute(x) for x in head]
    rows = lines.where(~F.trim("value").startswith("@") & ~F.trim("value").startswith("%") & (F.trim("value") != ""))
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(attrs))), {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    sparse = F.trim("value").startswith("{")
    pairs = F.transform(F.filter(F.split(F.regexp_replace("value", r"[{}]", ""), ","), lambda p: F.trim(p) != ""), lambda p: F.struct(F.split(F.trim(p), r"\s+", 2)[0].cast("int").alias("k"), F.split(F.trim(p), r"\s+", 2)[1].alias("v")))
    rows = rows.select(cells.alias("c"), F.when(sparse, F.map_from_entries(pairs)).alias("m"))
    out = []
    for i, a in enumerate(attrs):
        v = F.when(F.col("m").isNull(), F.trim(F.col(f"c.c{i}"), F.lit(" \"'"))).otherwise(F.coalesce(F.element_at("m", F.lit(i)), F.lit(a.values[0] if a.kind == "nominal" else "0")))
        v = F.when(v != "?", v)
        if a.kind == "nominal":
            at = F.array_position(F.array(*map(F.lit, a.values)), v)
            v = F.when(at > 0, (at - 1).cast("double"))
        out.append((v.try_cast("double") if a.kind == "numeric" else v).alias(a.name))
    df = rows.select(*out)
    return Dataset(df, _target(df, target), {a.name: a.values for a in attrs if a.kind == "nominal"}, (relation[0].split(None, 1)[1:] or [""])[0].strip("'\" ") if relation else "")


parse_arff = load_arff


def parse_arff_string(spark, content: str, target=-1) -> Dataset:
    return _arff(spark.createDataFrame([(x,) for x in content.splitlines()], "value string"), target)


def save_arff(path: str, df: DataFrame, labels: dict[str, list[str]] | None = None, relation: str = "data") -> None:
    labels = labels or {}
    head = [f"@relation '{relation}'", ""]
    for c, t in df.dtypes:
        kind = "{" + ",".join(labels[c]) + "}" if c in labels else "string" if t == "string" else "numeric"
        head.append(f"@attribute '{c}' {kind}")
    head += ["", "@data"]

    def cell(c: str, t: str) -> Column:
        v = F.element_at(F.array(*map(F.lit, labels[c])), F.col(c).cast("int") + 1) if c in labels else F.concat(F.lit("'"), F.col(c), F.lit("'")) if t == "string" else F.col(c).cast("string")
        return F.coalesce(v, F.lit("?"))

    body = df.select(F.concat_ws(",", *[cell(c, t) for c, t in df.dtypes]).alias("value"))
    top = df.sparkSession.createDataFrame([("\n".join(head),)], "value string")
    top.coalesce(1).unionByName(body).write.mode("overwrite").text(path)


write_arff = save_arff


def _bytes(spark, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def load_numpy(spark, path: str, target_key="y", data_key="X") -> Dataset:
    """.npy or .npz files that fit on the driver."""
    z = np.load(io.BytesIO(_bytes(spark, path)), allow_pickle=False)
    x = z if isinstance(z, np.ndarray) else z[data_key]
    names = [f"f{i}" for i in range(x.shape[1])] if isinstance(z, np.ndarray) or "feature_names" not in z else [str(v) for v in z["feature_names"]]
    pdf = pd.DataFrame(np.asarray(x, float), columns=names)
    if not isinstance(z, np.ndarray) and target_key in z:
        pdf["target"] = z[target_key]
    return Dataset(spark.createDataFrame(pdf), "target" if "target" in pdf else None)


def save_numpy(path: str, df: DataFrame, target: str | None = None, compressed: bool = True, max_rows: int = 10_000_000) -> None:
    if df.count() > max_rows:
        raise ValueError(f"more than {max_rows} rows; use save_parquet")
    pdf = df.toPandas()
    data = {"X": pdf.drop(columns=[target] if target else []).to_numpy(float), "feature_names": np.array([c for c in pdf.columns if c != target])}
    (np.savez_compressed if compressed else np.savez)(path, **data | ({"y": pdf[target].to_numpy()} if target else {}))


def load_excel(spark, path: str, target=-1, sheet_name=0, handle_categorical="encode") -> Dataset:
    df = spark.createDataFrame(pd.read_excel(io.BytesIO(_bytes(spark, path)), sheet_name=sheet_name))
    return encode(df, _target(df, target), handle_categorical)


def load_excel_sheets(spark, path: str, target=-1, handle_categorical="encode") -> dict[str, Dataset]:
    return {k: encode(d := spark.createDataFrame(v), _target(d, target), handle_categorical) for k, v in pd.read_excel(io.BytesIO(_bytes(spark, path)), sheet_name=None).items()}


def save_excel(path: str, df: DataFrame, sheet_name="Sheet1", max_rows: int = 1_000_000) -> None:
    df.limit(max_rows + 1).toPandas().to_excel(path, sheet_name=sheet_name, index=False)


def load_pandas(spark, pdf: pd.DataFrame, target=None, feature_columns=None, drop_columns=None, handle_categorical="encode") -> Dataset:
    pdf = pdf.drop(columns=list(drop_columns or ()))
    if feature_columns:
        pdf = pdf[[*feature_columns, *([target] if target else [])]]
    return encode(spark.createDataFrame(pdf), target, handle_categorical)


from_pandas = load_pandas


def to_pandas(data: Dataset, include_target: bool = True) -> pd.DataFrame:
    df = data.frame
    for c, names in data.labels.items():
        df = df.withColumn(c, F.element_at(F.array(*map(F.lit, names)), F.col(c).cast("int") + 1))
    return (df if include_target or not data.target else df.drop(data.target)).toPandas()


READERS = {"csv": load_csv, "tsv": lambda s, p, **k: load_csv(s, p, delimiter="\t", **k), "json": load_json, "jsonl": load_jsonl, "ndjson": load_jsonl, "parquet": load_parquet, "pq": load_parquet, "arff": load_arff, "npy": load_numpy, "npz": load_numpy, "xlsx": load_excel, "xls": load_excel}
WRITERS = {"csv": save_csv, "tsv": lambda p, d, **k: save_csv(p, d, delimiter="\t", **k), "json": save_json, "jsonl": save_jsonl, "parquet": save_parquet, "pq": save_parquet, "arff": save_arff, "npz": save_numpy, "xlsx": save_excel}


def load(spark: SparkSession, path: str, **kw) -> Dataset:
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix}")
    return READERS[suffix](spark, path, **kw)


def save(path: str, df: DataFrame, **kw) -> None:
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in WRITERS:
        raise ValueError(f"no writer for .{suffix}")
    WRITERS[suffix](path, df, **kw)


class Catalog:
    """Named tables: register(name, path, task), load_dataset(name), list_datasets(task)."""

    def __init__(self):
        self.items: dict[str, dict] = {}

    def register(self, name: str, path: str, task: str = "classification", **kw) -> None:
        self.items[name] = {"path": path, "task": task, "options": kw}

    def load_dataset(self, spark, name: str) -> Dataset:
        if name not in self.items:
            raise KeyError(f"no dataset named {name!r}")
        return load(spark, self.items[name]["path"], **self.items[name]["options"])

    def list_datasets(self, category: str | None = None) -> list[str]:
        return sorted(k for k, v in self.items.items() if category in (None, v["task"]))

    get_datasets_by_task = list_datasets

    def get_dataset_info(self, name: str | None = None) -> dict:
        return self.items[name] if name else self.items


catalog = Catalog()

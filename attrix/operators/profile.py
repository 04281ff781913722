"""Column-role detection (date / metric / dimension) in one aggregate job.

Rules (reference semantics):

* columns named ``id``, ``index``, ``序号``, ``编号`` (case-insensitive) get no role;
* date: parsed fraction of all rows > 0.5 when the name contains a date
  keyword, else > 0.9, and more than one distinct parsed value; runs before
  the numeric test (so ``yyyy`` / ``yyyyMMdd`` integers can be dates);
* numeric column: dimension if ``n_distinct < 10`` and
  ``n_distinct / rows < 0.05``, else metric;
* text column: strip ``,`` and ``%`` (percent is not divided by 100); if more
  than 80 % of rows parse as numbers it is numeric and follows the rule
  above, else a dimension.

Date parsing is bounded to an explicit format list, each guarded by a
regular expression, with the best-covering format chosen per column (a
lenient parser would read ``12345`` as year 12345).  Years are limited to
the span a nanosecond timestamp can hold (1678–2261).

Facts come from one wide aggregate per chunk of columns plus one bounded
exact-distinct pass (``profile_stats``), returned as a small frame with one
row per column; :func:`profile` turns it into the typed projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
NO_ROLE_NAMES = ["id", "index", "序号", "编号"]
DATE_KEYWORDS = ["date", "time", "日期", "时间", "dt", "day", "month", "year"]
# Missing-value tokens of the CSV reader (pandas defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Date formats tried per column: (guard regex, Spark datetime pattern).
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}$", "yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
]
MIN_YEAR, MAX_YEAR = 1678, 2261


@dataclass
class TableProfile:
    date_cols: list[str] = field(default_factory=list)
    numeric_cols: list[str] = field(default_factory=list)
    cat_cols: list[str] = field(default_factory=list)
    date_formats: dict = field(default_factory=dict)
    numeric_text_cols: list[str] = field(default_factory=list)


def has_date_keyword(name: str) -> bool:
    low = name.lower()
    return any(k in low for k in DATE_KEYWORDS)


def _parse(s: Column, regex: str, fmt: str) -> Column:
    # The regex guard short-circuits: the parser (which signals failure
    # internally with an exception) only sees strings of the right shape.
    ts = F.when(s.rlike(regex), F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz"))
    return F.when(F.year(ts).between(MIN_YEAR, MAX_YEAR), ts)


def _text(c: str, dt) -> Column:
    s = F.col(f"`{c}`").cast("string")
    if isinstance(dt, T.StringType):
        t = F.trim(s)
        # only digit-led strings can be dates: one cheap test gates the
        # per-format regexes and parsers
        s = F.when(F.substring(t, 1, 1).between("0", "9"), F.translate(t, "T", " "))
    return s


def _int_date(c: str, fmt: str) -> Column:
    """Integer columns as dates without string work: ``yyyy`` is a value in
    the year range, ``yyyyMMdd`` an 8-digit value parsed only in range."""
    v = F.col(f"`{c}`").cast("long")
    if fmt == "yyyy":
        return F.when(v.between(MIN_YEAR, MAX_YEAR),
                      F.make_timestamp_ntz(v.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0),
                                           F.lit(0)))
    return F.when(v.between(MIN_YEAR * 10000 + 101, MAX_YEAR * 10000 + 1231),
                  F.try_to_timestamp(v.cast("string"), F.lit("yyyyMMdd")).cast("timestamp_ntz"))


NUMBER_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _numeric_text(c: str) -> Column:
    # The shape test short-circuits the cast: a failed cast signals with an
    # exception internally, which would cost far more than the regex.
    cleaned = F.translate(F.trim(F.col(f"`{c}`").cast("string")), ",%", "")
    return F.when(cleaned.rlike(NUMBER_RE), cleaned.cast("double"))


def _kind(dt) -> str:
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "text"
    return "other"


PRESCREEN = 2000           # HLL estimate under which a set counts the distinct values


def _num_expr(c: str, kind: str) -> Column:
    return F.col(f"`{c}`").cast("double") if kind == "numeric" else _numeric_text(c)


def profile_stats(df: DataFrame, exclude: list[str] | None = None,
                  chunk: int = 12) -> DataFrame:
    """Per-column facts and the detected role.

    Columns: ``column, position, dtype, role, rows, non_null, n_distinct,
    date_fraction, date_format, numeric_fraction``.  ``n_distinct`` counts
    numbers (parsed numbers for text columns) and is exact.

    Pass 1 is one wide aggregate per chunk of ``chunk`` columns (Parquet
    reads only a chunk's columns, so the passes together read each column
    once); it carries counts, date-parse coverage per format, min/max and an
    HLL cardinality sketch.  Pass 2 counts distinct values: of the columns the
    sketch shows to be small with ``size(collect_set)``, whose state is bounded
    by that pre-screen; of the others in the long form ``(column, value)``,
    de-duplicated map side and hashed over all tasks, so no task holds a
    column's values.  The result has one row per column and is assembled on
    the driver."""
    exclude = set(exclude or [])
    spark = df.sparkSession
    fields = list(df.schema.fields)
    info = []
    for i, f in enumerate(fields):
        kind = "none" if (f.name.lower() in NO_ROLE_NAMES or f.name in exclude) else _kind(f.dataType)
        info.append((i, f.name, f.dataType, kind))
    facts: dict[int, dict] = {i: {} for i, *_ in info}
    rows_total = None
    for start in range(0, len(info), chunk):
        part = info[start:start + chunk]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c, dt, kind in part:
            col = F.col(f"`{c}`")
            aggs.append(F.count(col).alias(f"nn{i}"))
            if kind == "none":
                continue
            if kind == "temporal":
                p = col.cast("timestamp_ntz")
                aggs += [F.count(p).alias(f"d{i}_n"), F.min(p).alias(f"lo{i}_n"),
                         F.max(p).alias(f"hi{i}_n")]
            elif kind == "text" or isinstance(dt, (T.IntegerType, T.LongType, T.ShortType)):
                s = _text(c, dt)
                for j, (rx, fmt) in enumerate(DATE_FORMATS):
                    if kind != "text" and fmt not in ("yyyyMMdd", "yyyy"):
                        continue
                    p = _parse(s, rx, fmt) if kind == "text" else _int_date(c, fmt)
                    aggs += [F.count(p).alias(f"d{i}_{j}"), F.min(p).alias(f"lo{i}_{j}"),
                             F.max(p).alias(f"hi{i}_{j}")]
            if kind in ("numeric", "text"):
                v = _num_expr(c, kind)
                aggs += [F.count(v).alias(f"nv{i}"),
                         F.approx_count_distinct(v).alias(f"hll{i}")]
        r = df.agg(*aggs).first().asDict()
        rows_total = r["rows"]
        for i, *_ in part:
            facts[i] = {k: v for k, v in r.items()}
    small = [(i, c, kind) for i, c, dt, kind in info
             if kind in ("numeric", "text") and (facts[i].get(f"hll{i}") or 0) <= PRESCREEN]
    exact = {}
    if small:
        r = df.agg(*[F.size(F.collect_set(_num_expr(c, kind))).alias(f"x{i}")
                     for i, c, kind in small]).first()
        exact = {i: r[f"x{i}"] for i, _, _ in small}
    large = [(i, c, kind) for i, c, dt, kind in info if kind in ("numeric", "text") and i not in exact]
    if large:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), _num_expr(c, kind).alias("v")) for i, c, kind in large])
        long = df.select(F.explode(pairs).alias("p")).select("p.i", "p.v").where("v IS NOT NULL").distinct()
        exact |= {r["i"]: r["n"] for r in long.groupBy("i").agg(F.count("*").alias("n")).collect()}
        exact |= {i: 0 for i, _, _ in large if i not in exact}

    out = []
    n = rows_total or 0
    for i, c, dt, kind in info:
        fa = facts[i]
        nn = fa.get(f"nn{i}")
        if kind == "none":
            out.append((c, i, dt.simpleString(), "none", n, nn, None, None, None, None))
            continue
        cands = []
        if kind == "temporal":
            cands.append(("native", fa[f"d{i}_n"], fa[f"lo{i}_n"], fa[f"hi{i}_n"]))
        for j, (_, fmt) in enumerate(DATE_FORMATS):
            if f"d{i}_{j}" in fa:
                cands.append((fmt, fa[f"d{i}_{j}"], fa[f"lo{i}_{j}"], fa[f"hi{i}_{j}"]))
        best = max(cands, key=lambda t: t[1]) if cands else None   # first on ties
        dfrac = (best[1] / n) if (best and n) else 0.0
        thr = 0.5 if has_date_keyword(c) else 0.9
        is_date = bool(best and n and dfrac > thr and best[2] is not None and best[2] < best[3])
        nd = exact.get(i)
        nfrac = (fa.get(f"nv{i}", 0) / n) if (n and kind in ("numeric", "text")) else None
        low = nd is not None and nd < 10 and n and nd / n < 0.05
        if is_date:
            role = "date"
        elif kind == "numeric" or (kind == "text" and nfrac is not None and nfrac > 0.8):
            role = "dimension" if low else "metric"
        else:
            role = "dimension"
        out.append((c, i, dt.simpleString(), role, n, nn, nd, float(dfrac),
                    best[0] if is_date else None, None if nfrac is None else float(nfrac)))
    schema = ("column string, position int, dtype string, role string, rows long, "
              "non_null long, n_distinct long, date_fraction double, date_format string, "
              "numeric_fraction double")
    return spark.createDataFrame(out, schema)


def profile(df: DataFrame, exclude: list[str] | None = None) -> tuple[DataFrame, TableProfile]:
    """Detect roles and return the re-typed frame plus the role lists.

    The stats frame has one row per column (bounded by the schema width),
    so reading it on the driver is safe; the typed projection stays lazy."""
    stats = profile_stats(df, exclude).orderBy("position").collect()
    prof = TableProfile()
    out = []
    for r in stats:
        c = r["column"]
        dt = df.schema[c].dataType
        role = r["role"]
        if role == "date":
            prof.date_cols.append(c)
            fmt = r["date_format"]
            prof.date_formats[c] = fmt
            if fmt == "native":
                out.append(F.col(f"`{c}`").cast("timestamp_ntz").alias(c))
            else:
                rx = next(rx for rx, f in DATE_FORMATS if f == fmt)
                if isinstance(dt, T.StringType):
                    out.append(_parse(_text(c, dt), rx, fmt).alias(c))
                else:
                    out.append(_int_date(c, fmt).alias(c))
            continue
        if role in ("metric", "dimension") and isinstance(dt, T.StringType) and \
                (r["numeric_fraction"] or 0) > 0.8:
            prof.numeric_text_cols.append(c)
            out.append(_numeric_text(c).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
        if role == "metric":
            prof.numeric_cols.append(c)
        elif role == "dimension":
            prof.cat_cols.append(c)
    return df.select(*out), prof

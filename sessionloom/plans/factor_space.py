"""Factor-space diagnostic (AGG-25, JOB-49): scales, pair dependence, collinearity and principal components of a few columns over many rows.

The rows are reduced once: one aggregation gives the correlations of all pairs over complete rows. What follows works on a k x k matrix, k being the number of
columns, as array expressions of a single row: Jacobi rotations give eigenvalues and vectors, these the inverse's diagonal and the rest.
Linkage of columns into clusters is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.numeric import MAD_TO_SIGMA
from sessionloom.functions.ranking import median_mad, with_midrank
from sessionloom.functions.staging import cut
from sessionloom.operators.aggregates import correlation, rank_ic

#: Jacobi sweeps over all pairs; rotations converge quadratically, so a dozen is ample for tens of columns.
SWEEPS = 12
#: Shares of variance whose component counts are reported, and the least variance of a component that counts.
SHARES, KAISER = (0.80, 0.90, 0.95), 1.0
EPSILON = 2.220446049250313e-16


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` where x is evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def tall(panel: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, name, value of the finite values."""
    rows = panel.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "name", "value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def session_scaled(rows: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Mid-ranks within the session to (-1, 1), then one location and scale per column: scaled rows, scales."""
    ranked = with_midrank(rows, [session, "name"], "value").where("n_group >= 2")
    unit = cut(ranked.withColumn("unit", 2.0 * ((F.col("midrank") - 0.5) / F.col("n_group") - 0.5)).drop("n_lower", "n_tied", "n_group", "midrank"))
    scales = unit.groupBy("name").agg(F.count(F.lit(1)).alias("available"), F.avg("unit").alias("location"), F.stddev_samp("unit").alias("scale"), F.lit("same_session_midrank_then_development_scale").alias("method"))
    return _scaled(unit, "unit", scales), scales


def pooled_scaled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Median and 1.4826 MAD over all rows, the sample deviation where the MAD is zero: scaled rows, scales."""
    rows = cut(rows)
    spread = rows.groupBy("name").agg(F.count(F.lit(1)).alias("available"), F.stddev_samp("value").alias("sd"))
    scales = median_mad(rows, ["name"], "value").drop("n_group").join(spread, "name")
    robust = F.col("mad") * MAD_TO_SIGMA
    scales = scales.select("name", "available", F.col("med").alias("location"), F.when(robust > 0, robust).otherwise(F.col("sd")).alias("scale"),
                           F.when(robust > 0, "development_median_mad").otherwise("development_median_std_fallback").alias("method"))
    return _scaled(rows, "value", scales), scales


def _scaled(rows: DataFrame, value: str, scales: DataFrame) -> DataFrame:
    z = F.when(F.col("scale") > 0, (F.col(value) - F.col("location")) / F.col("scale"))
    return rows.join(scales.select("name", "location", "scale"), "name").withColumn("z", z).drop("location", "scale", "unit")


def wide(rows: DataFrame, keys: list[str], columns: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).pivot("name", columns).agg(F.max(value))


def correlation_row(scaled: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n complete rows and their correlation matrix; the matrix is null without enough support or variation."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = scaled.dropna(subset=columns).agg(F.count(F.lit(1)).alias("n"), *[correlation(columns[i], columns[j]).alias(f"_{i}_{j}") for i, j in pairs if i != j])
    cell = lambda i, j: F.lit(1.0) if i == j else F.col(f"_{min(i, j)}_{max(i, j)}")
    usable = reduce(lambda a, b: a & b, [F.col(f"_{i}_{j}").isNotNull() for i, j in pairs if i != j], F.col("n") > k)
    return row.select("n", F.when(usable, F.array(*[F.array(*[cell(i, j) for j in range(k)]) for i in range(k)])).alias("matrix"))


def eigen(matrix: Column, k: int, sweeps: int = SWEEPS) -> Column:
    """Struct (a: nearly diagonal matrix, v: eigenvectors in columns) of a symmetric k x k matrix."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(k) for q in range(p + 1, k)])
    n = k * (k - 1) // 2
    rotations = F.transform(F.sequence(F.lit(0), F.lit(sweeps * n - 1)), lambda i: pairs[i % n])
    identity = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(k)]) for i in range(k)])

    def angle(a: Column, r: Column) -> Column:
        apq = a[r["p"]][r["q"]]
        theta = (a[r["q"]][r["q"]] - a[r["p"]][r["p"]]) / (2.0 * apq)
        t = F.when(theta >= 0, 1.0).otherwise(-1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1.0))
        c = F.lit(1.0) / F.sqrt(t * t + 1.0)
        turned = F.abs(apq) > 1e-300
        return F.struct(F.when(turned, c).otherwise(1.0).alias("c"), F.when(turned, t * c).otherwise(0.0).alias("s"))

    def columns(m: Column, r: Column, g: Column) -> Column:
        left, right = lambda row: g["c"] * row[r["p"]] - g["s"] * row[r["q"]], lambda row: g["s"] * row[r["p"]] + g["c"] * row[r["q"]]
        return F.transform(m, lambda row: F.transform(row, lambda x, j: F.when(j == r["p"], left(row)).when(j == r["q"], right(row)).otherwise(x)))

    def lines(m: Column, r: Column, g: Column) -> Column:
        upper = lambda m: F.zip_with(m[r["p"]], m[r["q"]], lambda x, y: g["c"] * x - g["s"] * y)
        lower = lambda m: F.zip_with(m[r["p"]], m[r["q"]], lambda x, y: g["s"] * x + g["c"] * y)
        return _let(m, lambda m: F.transform(m, lambda row, i: F.when(i == r["p"], upper(m)).when(i == r["q"], lower(m)).otherwise(row)))

    def rotate(state: Column, r: Column) -> Column:
        return _let(angle(state["a"], r), lambda g: F.struct(lines(columns(state["a"], r, g), r, g).alias("a"), columns(state["v"], r, g).alias("v")))

    return F.aggregate(rotations, F.struct(matrix.alias("a"), identity.alias("v")), rotate)


def components(row: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, matrix, ``parts`` (eigenvalue, loadings; largest first) and ``vif``, null where the matrix is singular."""
    k = len(columns)
    e = row.withColumn("e", F.when(F.col("matrix").isNotNull(), eigen(F.col("matrix"), k)))
    parts = F.array(*[F.struct(F.col("e.a")[j][j].alias("value"), F.array(*[F.col("e.v")[i][j] for i in range(k)]).alias("loadings")) for j in range(k)])
    e = cut(e.select("n", "matrix", F.when(F.col("e").isNotNull(), F.reverse(F.array_sort(parts))).alias("parts")))

    def upright(p: Column) -> Column:
        top = F.array_max(F.transform(p["loadings"], F.abs))
        pivot = F.element_at(F.filter(p["loadings"], lambda x: F.abs(x) == top), 1)
        return F.struct(p["value"].alias("value"), F.transform(p["loadings"], lambda x: F.when(pivot < 0, -x).otherwise(x)).alias("loadings"))

    values = F.transform("parts", lambda p: p["value"])
    rank = F.size(F.filter(values, lambda x: F.abs(x) > F.array_max(values) * k * EPSILON))
    e = e.select("n", "matrix", F.transform("parts", upright).alias("parts"), F.when(F.col("parts").isNotNull(), rank).alias("rank"))

    def inflation(i: int) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["loadings"][i] * p["loadings"][i] / p["value"])

    vif = F.array(*[inflation(i) for i in range(k)])
    return e.withColumn("vif", F.when(F.col("rank") == k, vif))


def _entry(kind: str, item: Column | str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(item) if isinstance(item, str) else item).cast("string").alias("item"), value.cast("double").alias("value"))


def matrix_report(parts: DataFrame, columns: list[str]) -> DataFrame:
    """kind, item, value: variance inflation, components with their shares and loadings, rank, condition, participation, counts."""
    k = len(columns)
    values = F.transform("parts", lambda p: p["value"])
    total = lambda n: F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x)
    whole = total(k)
    entries = [_entry("complete_rows", "", F.col("n")), _entry("rank", "", F.col("rank")), _entry("kaiser", "", F.size(F.filter(values, lambda x: x > KAISER))),
               _entry("participation", "", whole * whole / F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)),
               _entry("condition", "", F.when(F.col("rank") == k, F.array_max(values) / F.array_min(values)))]
    entries += [_entry("vif", c, F.col("vif")[i]) for i, c in enumerate(columns)]
    for j in range(k):
        entries += [_entry("eigenvalue", f"{j + 1}", values[j]), _entry("ratio", f"{j + 1}", values[j] / whole), _entry("cumulative", f"{j + 1}", total(j + 1) / whole)]
        entries += [_entry("loading", f"{j + 1}:{c}", F.col("parts")[j]["loadings"][i]) for i, c in enumerate(columns)]
    reached = lambda share: F.array_min(F.array(*[F.when(total(j + 1) / whole >= share, F.lit(j + 1)) for j in range(k)]))
    entries += [_entry("components", f"{int(100 * s)}", reached(s)) for s in SHARES]
    return parts.select(F.inline(F.array(*entries)))


def pair_report(panel: DataFrame, scaled: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """kind, item, value per pair of columns: rows with both, rows with neither, correlation of the scaled values, rank correlation of the raw ones."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    has = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns}
    support = panel.agg(*[F.count_if(has[a] & has[b]).alias(f"both {a}/{b}") for a, b in pairs], *[F.count_if(~has[a] & ~has[b]).alias(f"neither {a}/{b}") for a, b in pairs])
    support = support.select(F.inline(F.array(*[_entry(kind, f"{a}/{b}", F.col(f"{kind} {a}/{b}")) for a, b in pairs for kind in ("both", "neither")])))
    linear = scaled.agg(*[correlation(a, b).alias(f"{a}/{b}") for a, b in pairs])
    linear = linear.select(F.inline(F.array(*[_entry("pearson", f"{a}/{b}", F.col(f"{a}/{b}")) for a, b in pairs])))
    sides = F.array(*[F.when(has[a] & has[b], F.struct(F.lit(f"{a}/{b}").alias("item"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))) for a, b in pairs])
    ranks = rank_ic(cut(panel.select(F.inline(F.array_compact(sides)))), ["item"], "x", "y", 3)
    return reduce(DataFrame.unionByName, [support, linear, ranks.select(F.lit("rank_dependence").alias("kind"), "item", F.col("ic").alias("value"))])


def diagnostic(panel: DataFrame, keys: list[str], columns: list[str], session: str | None = None) -> DataFrame:
    """The whole report of one panel as kind, item, value; a ``session`` column makes it a cross-section panel."""
    panel = cut(panel.select(*keys, *columns))
    rows = tall(panel, keys, columns)
    scaled, scales = session_scaled(rows, session) if session else pooled_scaled(rows)
    grid = cut(wide(scaled, keys, columns, "z"))
    named = F.when(F.col("method") == "development_median_std_fallback", 1).otherwise(0)
    about = scales.select(F.inline(F.array(_entry("available", F.col("name"), F.col("available")), _entry("location", F.col("name"), F.col("location")), _entry("scale", F.col("name"), F.col("scale")), _entry("std_fallback", F.col("name"), named))))
    size = panel.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(_entry("rows", "", F.col("n")))))
    report = matrix_report(components(correlation_row(grid, columns), columns), columns)
    return reduce(DataFrame.unionByName, [size, about, pair_report(panel, grid, keys, columns), report])

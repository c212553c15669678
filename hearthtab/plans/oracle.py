"""DuckDB SQL giving the same rows as every query, written apart from the Spark code."""

from __future__ import annotations

_PERSON = """
lines AS (
  SELECT l.*, o.o_orderkey, o.o_custkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                       l_quantity, l_extendedprice, l_shipdate) AS rn,
    count(*) OVER (PARTITION BY l_orderkey) AS persons
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
),
person AS (
  SELECT
    CAST(CASE WHEN o_orderkey % 28 < 4 THEN 1960 + 10 * (o_orderkey % 28)
              ELSE 1996 + o_orderkey % 28 END AS INTEGER) AS "YEAR",
    CAST(l_orderkey AS BIGINT) AS "SERIAL",
    CAST(rn AS INTEGER) AS "PERNUM",
    CAST(persons AS INTEGER) AS "NUMPREC",
    CAST(l_quantity AS DOUBLE) AS "PERWT",
    CAST(1 + o_custkey % 100 AS DOUBLE) AS "HHWT",
    CAST(CASE WHEN o_custkey % 10 < 6 THEN 1 WHEN o_custkey % 10 < 8 THEN 2
              WHEN o_custkey % 10 = 8 THEN 3 ELSE 4 END AS INTEGER) AS "GQ",
    CAST(l_partkey % 95 AS INTEGER) AS "AGE",
    CAST(1 + l_suppkey % 2 AS INTEGER) AS "SEX",
    CAST(1 + l_suppkey % 9 AS INTEGER) AS "RACE",
    CAST(CASE WHEN l_partkey % 20 = 19 THEN 9 WHEN l_partkey % 5 = 0 THEN 1 + l_suppkey % 4
              ELSE 0 END AS INTEGER) AS "HISPAN",
    CAST(CASE WHEN rn = 1 THEN 1 ELSE 2 + (l_partkey + l_linenumber) % 11 END AS INTEGER)
      AS "RELATE",
    CAST(o_custkey % 7 AS INTEGER) AS "NFAMS",
    CAST(1 + o_custkey % 12 AS INTEGER) AS "ROOMS",
    CAST(o_custkey % 8 AS INTEGER) AS "BEDROOMS",
    CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS "OWNERSHP",
    CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 100 + (o_orderkey * 37) % 4400 END AS INTEGER)
      AS "RENT",
    CAST(CASE WHEN o_custkey % 4 = 0 THEN 5350 ELSE 0 END AS INTEGER) AS "CITY",
    CAST(l_partkey % 12 AS INTEGER) AS "EDUC",
    CAST(CASE WHEN l_partkey % 95 < 15 THEN 9999999
              WHEN l_suppkey % 4 = 0 THEN floor(l_extendedprice) * 3 - 25000
              WHEN l_suppkey % 4 = 1 THEN -3 * floor(l_extendedprice / 10)
              ELSE floor(l_extendedprice / 10) END AS INTEGER) AS "INCTOT"
  FROM lines
)"""

# Year, nominal bottom code, nominal top code, factor to 2023 dollars.
_PARAMETERS = """
  (1960, -1911, 23886, 10.466),
  (1970, -2409, 30121, 8.300),
  (1980, -4766, 59586, 4.196),
  (1990, -8139, 101749, 2.457),
  (2000, -11312, 141417, 1.768),
  (2001, -11625, 145324, 1.720),
  (2002, -11813, 147678, 1.693),
  (2003, -12087, 151105, 1.654),
  (2004, -12402, 155045, 1.612),
  (2005, -12824, 160317, 1.559),
  (2006, -13243, 165557, 1.510),
  (2007, -13606, 170087, 1.470),
  (2008, -14133, 176680, 1.415),
  (2009, -14078, 175997, 1.420),
  (2010, -14318, 178992, 1.397),
  (2011, -14762, 184548, 1.355),
  (2012, -15067, 188361, 1.327),
  (2013, -15299, 191259, 1.307),
  (2014, -15538, 194247, 1.287),
  (2015, -15560, 194523, 1.285),
  (2016, -15762, 197046, 1.269),
  (2017, -16110, 201399, 1.241),
  (2018, -16499, 206259, 1.212),
  (2019, -16777, 209739, 1.192),
  (2020, -16986, 212345, 1.177),
  (2021, -17787, 222358, 1.124),
  (2022, -19225, 240334, 1.040),
  (2023, -19998, 250000, 1.000)
"""

_CODED = f"""
income_years AS (
  SELECT y, lowest, highest, CAST(factor AS DECIMAL(6,3)) AS factor
  FROM (VALUES {_PARAMETERS}) v(y, lowest, highest, factor)
),
step1 AS (
  SELECT p.*,
    CASE WHEN "NFAMS" < 0 THEN NULL WHEN "NFAMS" < 5 THEN "NFAMS" WHEN "NFAMS" >= 5 THEN 5 END
      AS n_multifam,
    CASE WHEN "ROOMS" >= 9 THEN 9 ELSE "ROOMS" END AS room,
    CASE "BEDROOMS" WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3
      WHEN 5 THEN 4 ELSE 5 END AS bedroom,
    CASE WHEN "AGE" >= 65 THEN '65 and older' WHEN "AGE" >= 50 THEN '50-65'
      WHEN "AGE" >= 30 THEN '30-49' WHEN "AGE" >= 18 THEN '18-29'
      WHEN "AGE" IS NOT NULL THEN '17 or younger' END AS age_bucket,
    CASE "HISPAN" WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN TRUE
      WHEN 4 THEN TRUE END AS is_hispan,
    CASE "RACE" WHEN 1 THEN 'white' WHEN 2 THEN 'black' WHEN 3 THEN 'aian' WHEN 4 THEN 'aapi'
      WHEN 5 THEN 'aapi' WHEN 6 THEN 'aapi' WHEN 7 THEN 'other' WHEN 8 THEN 'multi'
      WHEN 9 THEN 'multi' END AS race_bucket,
    CASE WHEN "INCTOT" = 9999999 THEN NULL
      WHEN "INCTOT" <= lowest THEN CAST(-19998 AS DECIMAL(19,3))
      WHEN "INCTOT" >= highest THEN CAST(250000 AS DECIMAL(19,3))
      ELSE CAST("INCTOT" * factor AS DECIMAL(19,3)) END AS inctot_harmonized
  FROM person p LEFT JOIN income_years ON y = "YEAR"
),
coded AS (
  SELECT *,
    CASE WHEN n_multifam = 1 THEN FALSE WHEN n_multifam > 1 THEN TRUE END AS is_multifam,
    CAST("NUMPREC" AS DOUBLE) / CAST(bedroom AS DOUBLE) AS ppbr,
    CASE WHEN is_hispan THEN 'Hispanic'
      ELSE CASE race_bucket WHEN 'white' THEN 'White' WHEN 'black' THEN 'Black'
        WHEN 'aian' THEN 'AIAN' WHEN 'aapi' THEN 'AAPI' WHEN 'multi' THEN 'Multiracial'
        WHEN 'other' THEN 'Other' END END AS race_eth
  FROM step1
)"""

_HOUSEHOLD = """
household AS (
  SELECT "YEAR", "SERIAL",
    count(*) AS hh_size,
    arg_min("NUMPREC", "PERNUM") AS "NUMPREC",
    arg_min_null(room, "PERNUM") AS room,
    arg_min_null(bedroom, "PERNUM") AS bedroom,
    arg_min("GQ", "PERNUM") AS "GQ",
    arg_min("HHWT", "PERNUM") AS "HHWT",
    max(n_multifam) AS n_multifam,
    bool_or(is_multifam) AS is_multifam,
    CAST(sum(inctot_harmonized) AS DOUBLE) AS hhinc_harmonized,
    CAST(sum(CAST("AGE" >= 18 AS INTEGER)) AS BIGINT) AS n_adults,
    CAST(sum(CAST("AGE" < 18 AS INTEGER)) AS BIGINT) AS n_children,
    CAST(sum(CAST("RELATE" = 2 AS INTEGER)) AS BIGINT) AS n_spouse,
    CAST(sum(CAST("RELATE" = 3 AS INTEGER)) AS BIGINT) AS n_child,
    CAST(sum(CAST("RELATE" IN (5, 6) AS INTEGER)) AS BIGINT) AS n_parent,
    CAST(sum(CAST("RELATE" = 9 AS INTEGER)) AS BIGINT) AS n_grandchild,
    CAST(sum(CAST("RELATE" IN (4, 7, 8, 10) AS INTEGER)) AS BIGINT) AS n_other_rel,
    CAST(sum(CAST("RELATE" IN (11, 12) AS INTEGER)) AS BIGINT) AS n_non_rel
  FROM coded GROUP BY "YEAR", "SERIAL"
)"""

_MERGED = """
merged AS (
  SELECT p.*, h.hh_size, h."NUMPREC" AS "NUMPREC_hh", h.room AS room_hh, h.bedroom AS bedroom_hh,
    h."GQ" AS "GQ_hh", h."HHWT" AS "HHWT_hh", h.n_multifam AS n_multifam_hh,
    h.is_multifam AS is_multifam_hh, h.hhinc_harmonized, h.n_adults, h.n_children, h.n_spouse,
    h.n_child, h.n_parent, h.n_grandchild, h.n_other_rel, h.n_non_rel
  FROM coded p LEFT JOIN household h ON p."YEAR" = h."YEAR" AND p."SERIAL" = h."SERIAL"
)"""

_MODEL = """
model AS (SELECT * FROM merged WHERE "AGE" >= 18 AND "AGE" <= 65 AND "PERNUM" = 1),
renter AS (
  SELECT *, CAST("RENT" * 12 AS DOUBLE) / nullif(hhinc_harmonized, 0) AS rent_burden,
    CAST("RENT" * 13 AS DOUBLE) / nullif(hhinc_harmonized, 0) AS rent_burden_13
  FROM model
  WHERE "OWNERSHP" = 2 AND "RENT" IS NOT NULL AND hhinc_harmonized IS NOT NULL
    AND hhinc_harmonized > 0
)"""

_BURDEN_BANDS = ", ".join(
    f"({i + 1}, CAST('{i * 0.05!r}' AS DOUBLE), CAST('{(i + 1) * 0.05!r}' AS DOUBLE), "
    f"'{5 * i}–{5 * i + 4}.9')"
    for i in range(40)
)
_RENT_BANDS = ", ".join(
    f"({i + 1}, {200 * i}, {200 * (i + 1)}, '${200 * i}–${200 * (i + 1)}')" for i in range(20)
)
_BANDS = f"""
burden_band(band_rank, lo, hi, band) AS (VALUES {_BURDEN_BANDS}),
rent_band(band_rank, lo, hi, band) AS (VALUES {_RENT_BANDS})"""


def _in_band(value: str, bands: str, last: int) -> str:
    return (
        f"LEFT JOIN {bands} b ON {value} >= b.lo "
        f"AND ({value} < b.hi OR (b.band_rank = {last} AND {value} <= b.hi))"
    )


_BY_BURDEN = _in_band("rent_burden", "burden_band", 40)
_BY_RENT = _in_band('"RENT"', "rent_band", 20)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


# A third of all orders as one household, with the smallest of its customers.
_HOT_PERSON = f"""
hot_lineitem AS (
  SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 280000007 ELSE l_orderkey END AS l_orderkey)
  FROM lineitem
),
hot_orders AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 280000007 ELSE o_orderkey END AS o_orderkey,
    min(o_custkey) AS o_custkey
  FROM orders GROUP BY 1
),
{_PERSON.strip().replace("FROM lineitem l JOIN orders o", "FROM hot_lineitem l JOIN hot_orders o")}"""

_ON_PERSON = _with(_PERSON)
_ON_CODED = _with(_PERSON, _CODED)
_ON_HOUSEHOLD = _with(_PERSON, _CODED, _HOUSEHOLD)
_ON_MERGED = _with(_PERSON, _CODED, _HOUSEHOLD, _MERGED)
_ON_MODEL = _with(_PERSON, _CODED, _HOUSEHOLD, _MERGED, _MODEL, _BANDS)

_PERSON_KEY = '"YEAR", "SERIAL", "PERNUM"'
_COMPONENTS = ("n_spouse", "n_child", "n_parent", "n_grandchild", "n_other_rel", "n_non_rel")
_COUNTS = "sum({w}) AS weighted_count, count(*) AS count"


def _recode(*columns: str) -> str:
    return f"{_ON_CODED} SELECT {_PERSON_KEY}, {', '.join(columns)} FROM coded"


def _percent(source: str, weight: str, groups: str, within: str, where: str, keep: str) -> str:
    """Percent of ``weight`` in each group, within ``within``; ``keep`` filters cells."""
    return f"""
cells AS (SELECT {groups}, {_COUNTS.format(w=weight)} FROM {source} WHERE {where}
          GROUP BY {groups}),
totals AS (SELECT {within}, sum(weighted_count) AS total FROM cells GROUP BY {within}),
result AS (
  SELECT c.*, 100.0::DOUBLE * c.weighted_count / t.total AS percent
  FROM cells c JOIN totals t ON {' AND '.join(
      f'c.{g.strip()} IS NOT DISTINCT FROM t.{g.strip()}' for g in within.split(','))}
  WHERE {keep}
)
SELECT * FROM result"""


_HH_POPULATION = '"GQ" IN (0, 1, 2)'
_MEANS = ", ".join(f'sum("HHWT" * {c}) / sum("HHWT") AS {c}' for c in _COMPONENTS)
_COMPONENT_TABLE = f"""
components AS (SELECT "YEAR", {_MEANS} FROM household WHERE {_HH_POPULATION} GROUP BY "YEAR")"""
_NORMALIZED = ", ".join(
    f"round(c.{name} / nullif(b.{name}, 0), 9) AS {name}" for name in _COMPONENTS
)
_NORMALIZED_TABLE = f"""
normalized AS (
  SELECT c."YEAR", {_NORMALIZED}
  FROM components c JOIN components b ON b."YEAR" = 2023
)"""

_STACK = (
    ("n_non_rel", "Non-relatives"),
    ("n_other_rel", "Other relatives"),
    ("n_parent", "Parents / in-laws"),
    ("n_grandchild", "Grandchildren"),
    ("n_child", "Children"),
    ("n_spouse", "Spouse"),
)
_LONG = " UNION ALL ".join(
    [
        f"""SELECT "YEAR", '{name}' AS component, '{label}' AS label, {rank} AS rank,
            {name} AS value FROM components"""
        for rank, (name, label) in enumerate(_STACK, 1)
    ]
    + [
        """SELECT "YEAR", 'reference_person', 'Reference person', 7, CAST(1 AS DOUBLE)
           FROM components"""
    ]
)
_SINGULAR = ("Spouse", "Child", "Parent", "Grandchild", "Other relative", "Non-relative")
_NORMALIZED_LONG = " UNION ALL ".join(
    f"""SELECT "YEAR", '{name}' AS component, '{label}' AS label, {name} AS relative_value
        FROM normalized"""
    for name, label in zip(_COMPONENTS, _SINGULAR)
)


def _share(extra: str, keep: str) -> str:
    groups = ", ".join(["is_multifam", '"YEAR"', *([extra] if extra else [])])
    within = ", ".join(['"YEAR"', *([extra] if extra else [])])
    return _percent("coded", '"PERWT"', groups, within, _HH_POPULATION, keep)


def _share_part(breakdown: str, race: str, age: str, keep: str) -> str:
    return f"""
  SELECT '{breakdown}' AS breakdown, "YEAR", race_eth, age_bucket, w AS weighted_count, n AS count,
    100.0::DOUBLE * w / total AS percent
  FROM (
    SELECT *, sum(w) OVER (PARTITION BY "YEAR", race_eth, age_bucket) AS total
    FROM (
      SELECT is_multifam, "YEAR", {race} AS race_eth, {age} AS age_bucket, sum("PERWT") AS w,
        count(*) AS n
      FROM coded WHERE {_HH_POPULATION} GROUP BY ALL
    )
  ) WHERE is_multifam AND {keep}"""


_SHARE_TABLES = " UNION ALL ".join(
    [
        _share_part("all", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "TRUE"),
        _share_part(
            "race_eth",
            "race_eth",
            "CAST(NULL AS VARCHAR)",
            "race_eth IN ('White', 'Black', 'Hispanic')",
        ),
        _share_part("age_bucket", "CAST(NULL AS VARCHAR)", "age_bucket", "TRUE"),
    ]
)


def _children(cap: int, source: str, where: str, value: str) -> str:
    return f"""{_ON_MODEL}
SELECT CAST(least(n_child, {cap}) AS INTEGER) AS n_child_group, {value}, count(*) AS n
FROM {source} WHERE {where} GROUP BY 1"""


def _band_counts(source: str, join: str, where: str) -> str:
    return f"""{_ON_MODEL}
SELECT band, band_rank, count(*) AS n FROM {source} {join} WHERE {where} GROUP BY band, band_rank"""


_BURDEN_0_2 = "rent_burden > 0 AND rent_burden < 2"
_LOW = "hhinc_harmonized >= 0 AND hhinc_harmonized < 20000"


def _rent_table(kind: str, year: str, city: str = "TRUE") -> str:
    if kind == "city":
        source = f"renter {_BY_BURDEN}"
        where = f"n_child > 0 AND {_BURDEN_0_2} AND {year}"
        groups, within = 'band, band_rank, is_multifam, "CITY"', 'is_multifam, "CITY"'
        weight, keep = '"PERWT"', f"c.is_multifam AND c.band IS NOT NULL AND {city}"
    elif kind == "low":
        source = f"renter {_BY_BURDEN}"
        where = f"{_LOW} AND {_BURDEN_0_2} AND {year}"
        groups, within = "band, band_rank, is_multifam", "is_multifam"
        weight, keep = '"HHWT_hh"', "c.is_multifam AND c.band IS NOT NULL"
    else:
        value = 'CAST("RENT" AS DOUBLE) / nullif(CAST("NFAMS" AS DOUBLE), 0)'
        source = f"renter {_in_band(f'({value})', 'rent_band', 20)}"
        where = f'{_LOW} AND "RENT" < 4000 AND {year}'
        groups, within = "band, band_rank, is_multifam", "is_multifam"
        weight, keep = '"HHWT_hh"', "c.is_multifam"
    return f"{_ON_MODEL},{_percent(source, weight, groups, within, where, keep)}"


def _lpm_sql(
    controls: tuple[str, ...],
    income: str = "hhinc_harmonized",
    centred: bool = True,
    shift: str = "0",
) -> str:
    """Cross products of the model's terms per year, in long form, as CTEs.

    ``terms`` numbers the terms of each year, the outcome last; ``cross0`` holds
    every product in both orders. ``centred`` takes the weighted mean of the year off numeric controls;
    ``shift`` is added to the rent where that is a control.
    """
    text_controls = {"age_bucket"}
    numeric = [k for k, c in enumerate(controls, 1) if centred and c not in text_controls]
    known = " AND ".join(f"{c} IS NOT NULL" for c in controls) or "TRUE"
    parts = ["SELECT rid, \"YEAR\", w, 0 AS slot, 'race_eth' || race_eth AS term, 1.0 AS x FROM obs"]
    for slot, control in enumerate(controls, 1):
        if control in text_controls:
            parts.append(
                f"""SELECT rid, "YEAR", w, {slot}, '{control}' || {control}, 1.0
                FROM (SELECT *, min({control}) OVER (PARTITION BY "YEAR") AS base FROM obs)
                WHERE {control} <> base"""
            )
        else:
            name = control.strip('"')
            value = income if name == "hhinc_harmonized" else control
            if name == "shifted_rent":
                value = f'"RENT" + {shift}'
            parts.append(
                f"""SELECT rid, "YEAR", w, {slot}, '{name}', CAST({value} AS DOUBLE) FROM obs"""
            )
    parts.append(
        f"""SELECT rid, "YEAR", w, {len(controls) + 1}, 'is_multifam',
        CAST(CAST(is_multifam AS INTEGER) AS DOUBLE) FROM obs"""
    )
    return f"""{_ON_MODEL},
pool AS (
  SELECT *, "PERWT" AS w, min(race_eth) OVER (PARTITION BY "YEAR") AS baseline
  FROM (SELECT *, "RENT" AS shifted_rent FROM model)
  WHERE is_multifam IS NOT NULL AND race_eth IS NOT NULL AND "PERWT" IS NOT NULL
),
obs AS (SELECT *, row_number() OVER () AS rid FROM pool WHERE w > 0 AND {known}),
design0 AS MATERIALIZED ({' UNION ALL '.join(parts)}),
centres AS MATERIALIZED (
  SELECT "YEAR", slot, term, sum(w * x) / sum(w) AS c FROM design0
  WHERE slot IN ({', '.join(map(str, numeric)) or '-1'}) GROUP BY "YEAR", slot, term
),
design AS MATERIALIZED (
  SELECT d.rid, d."YEAR", d.w, d.slot, d.term, d.x - coalesce(c.c, 0) AS x
  FROM design0 d LEFT JOIN centres c ON c."YEAR" = d."YEAR" AND c.slot = d.slot
),
terms AS MATERIALIZED (
  SELECT "YEAR", slot, term, row_number() OVER (PARTITION BY "YEAR" ORDER BY slot, term) AS k
  FROM (SELECT DISTINCT "YEAR", slot, term FROM design)
),
cross0 AS MATERIALIZED (
  SELECT a."YEAR", ta.k AS i, tb.k AS j, sum(a.w * a.x * b.x) AS v
  FROM design a JOIN design b ON a.rid = b.rid
  JOIN terms ta ON ta."YEAR" = a."YEAR" AND ta.term = a.term AND ta.slot = a.slot
  JOIN terms tb ON tb."YEAR" = b."YEAR" AND tb.term = b.term AND tb.slot = b.slot
  GROUP BY a."YEAR", ta.k, tb.k
),
sized AS (
  SELECT "YEAR", count(*) AS n, min(baseline) AS baseline FROM obs GROUP BY "YEAR"
)"""


def _lpm_stats() -> str:
    controls = ("age_bucket", '"SEX"', "hhinc_harmonized", '"EDUC"')
    return f"""{_lpm_sql(controls, "floor(hhinc_harmonized / 100)", centred=False)}
SELECT c."YEAR", a.term AS i, b.term AS j, c.v AS value
FROM cross0 c JOIN terms a ON a."YEAR" = c."YEAR" AND a.k = c.i
JOIN terms b ON b."YEAR" = c."YEAR" AND b.k = c.j
WHERE (a.slot, a.term) <= (b.slot, b.term) AND (a.slot < b.slot OR a.term = b.term)
UNION ALL SELECT "YEAR", '(rows)', '(rows)', CAST(n AS DOUBLE) FROM sized"""


def _lpm_fit(
    controls: tuple[str, ...], max_terms: int, all_terms: bool = False, shift: str = "0"
) -> str:
    """Regression by sweeping the cross products, and exact p-values.

    Sweeping every predictor leaves the coefficients in the outcome's column, the
    residual sum of squares in its corner and minus the inverse elsewhere. With
    whole degrees of freedom Student's t has a finite cosine series.
    """
    full = """
full0 AS MATERIALIZED (
  SELECT a."YEAR", a.k AS i, b.k AS j, coalesce(c.v, 0.0) AS v
  FROM terms a JOIN terms b ON a."YEAR" = b."YEAR"
  LEFT JOIN cross0 c ON c."YEAR" = a."YEAR" AND c.i = a.k AND c.j = b.k
),
last AS (SELECT "YEAR", max(k) AS y FROM terms GROUP BY "YEAR")"""
    sweeps = [
        f"""
pivot{k} AS MATERIALIZED (
  SELECT f."YEAR", {k} AS k, f.v FROM full{k - 1} f
  JOIN full0 o ON o."YEAR" = f."YEAR" AND o.i = f.i AND o.j = f.j
  JOIN last l ON l."YEAR" = f."YEAR"
  WHERE f.i = {k} AND f.j = {k} AND {k} < l.y AND f.v > 1e-12 * o.v
),
full{k} AS MATERIALIZED (
  SELECT m."YEAR", m.i, m.j,
    CASE WHEN p.v IS NULL THEN m.v
      WHEN m.i = {k} AND m.j = {k} THEN -1.0 / p.v
      WHEN m.i = {k} OR m.j = {k} THEN m.v / p.v
      ELSE m.v - r.v * c.v / p.v END AS v
  FROM full{k - 1} m
  LEFT JOIN pivot{k} p ON p."YEAR" = m."YEAR"
  LEFT JOIN full{k - 1} r ON r."YEAR" = m."YEAR" AND r.i = m.i AND r.j = {k}
  LEFT JOIN full{k - 1} c ON c."YEAR" = m."YEAR" AND c.i = {k} AND c.j = m.j
)"""
        for k in range(1, max_terms + 1)
    ]
    pivots = " UNION ALL ".join(f"SELECT * FROM pivot{k}" for k in range(1, max_terms + 1))
    swept = f"full{max_terms}"
    fit = f"""
pivots AS MATERIALIZED ({pivots}),
fitted AS (
  SELECT s."YEAR", s.baseline, l.y, s.n - p.rank AS df,
    CASE WHEN r.v < 1e-12 * o.v THEN 0 ELSE r.v END AS rss
  FROM sized s JOIN last l ON l."YEAR" = s."YEAR"
  JOIN (SELECT "YEAR", count(*) AS rank FROM pivots GROUP BY "YEAR") p ON p."YEAR" = s."YEAR"
  JOIN {swept} r ON r."YEAR" = s."YEAR" AND r.i = l.y AND r.j = l.y
  JOIN full0 o ON o."YEAR" = s."YEAR" AND o.i = l.y AND o.j = l.y
),
known AS MATERIALIZED (SELECT "YEAR", k FROM pivots),
-- Every kept term is its own swept coefficient; race terms lose the controls at their centres.
moves AS MATERIALIZED (
  SELECT k."YEAR", k.k AS t, k.k AS s, 1.0 AS m FROM known k
  UNION ALL
  SELECT g."YEAR", g.k, n.k, -c.c
  FROM known g JOIN terms tg ON tg."YEAR" = g."YEAR" AND tg.k = g.k AND tg.slot = 0
  JOIN known n ON n."YEAR" = g."YEAR"
  JOIN terms tn ON tn."YEAR" = n."YEAR" AND tn.k = n.k
  JOIN centres c ON c."YEAR" = n."YEAR" AND c.slot = tn.slot AND c.term = tn.term
),
moved AS MATERIALIZED (
  SELECT m."YEAR", m.t, sum(m.m * b.v) AS b
  FROM moves m JOIN fitted f ON f."YEAR" = m."YEAR"
  JOIN {swept} b ON b."YEAR" = m."YEAR" AND b.i = m.s AND b.j = f.y
  GROUP BY m."YEAR", m.t
),
spread AS MATERIALIZED (
  SELECT m."YEAR", m.t, sum(m.m * n.m * -d.v) AS v
  FROM moves m JOIN moves n ON n."YEAR" = m."YEAR" AND n.t = m.t
  JOIN {swept} d ON d."YEAR" = m."YEAR" AND d.i = m.s AND d.j = n.s
  GROUP BY m."YEAR", m.t
),
fit AS MATERIALIZED (
  SELECT t."YEAR", t.term, f.baseline, f.df, b.b AS estimate,
    CASE WHEN f.df > 0 AND d.v IS NOT NULL THEN sqrt(greatest(d.v, 0) * f.rss / f.df) END
      AS std_error
  FROM terms t JOIN fitted f ON f."YEAR" = t."YEAR" AND t.k < f.y
  LEFT JOIN moved b ON b."YEAR" = t."YEAR" AND b.t = t.k
  LEFT JOIN spread d ON d."YEAR" = t."YEAR" AND d.t = t.k
),
angle AS (
  SELECT *, estimate / nullif(std_error, 0) AS statistic,
    CASE WHEN df > 0 THEN atan(abs(estimate / nullif(std_error, 0)) / sqrt(df)) END AS theta
  FROM fit
),
steps AS (
  SELECT "YEAR", term, df, theta, unnest(generate_series(1, (df - 2 - df % 2) // 2)) AS s
  FROM angle WHERE df > 3 AND theta IS NOT NULL
),
series AS (
  SELECT "YEAR", term, sum(c) AS tail FROM (
    SELECT "YEAR", term, exp(sum(
      CASE WHEN df % 2 = 0 THEN ln((2.0 * s - 1) / (2.0 * s)) ELSE ln(2.0 * s / (2.0 * s + 1)) END
      + 2 * ln(cos(theta))) OVER (PARTITION BY "YEAR", term ORDER BY s)) AS c
    FROM steps
  ) GROUP BY "YEAR", term
),
tested AS (
  SELECT a.*,
    CASE WHEN df < 1 OR theta IS NULL THEN NULL
      WHEN df = 1 THEN 1 - 2 * theta / pi()
      WHEN df % 2 = 0 THEN 1 - sin(theta) * (1 + coalesce(tail, 0))
      ELSE 1 - 2 / pi() * (theta + sin(theta) * cos(theta) * (1 + coalesce(tail, 0)))
    END AS p_value
  FROM angle a LEFT JOIN series USING ("YEAR", term)
)"""
    rounded = """round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
  round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, "YEAR", baseline"""
    if all_terms:
        select = f"SELECT term, {rounded} FROM tested"
    else:
        select = f"""SELECT shown AS term, {rounded}, term_rank
FROM tested JOIN (VALUES ('Hispanic', 1), ('AIAN', 2), ('AAPI', 3), ('Black', 4), ('White', 5))
  r(shown, term_rank) ON term = 'race_eth' || shown"""
    return ",".join([_lpm_sql(controls, shift=shift), full, *sweeps, fit]) + select


def _csv(table: str, header: str, cells: dict[str, str], quote: str = "") -> str:
    """The lines of a result file: plain decimals, TRUE and FALSE, text in ``quote`` signs."""
    plain = "regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
    kinds = {
        "number": plain,
        "boolean": "upper(CAST({x} AS VARCHAR))",
        "text": f"'{quote}' || {{x}} || '{quote}'",
        "six": plain.replace("{x}", "round({x}, 6)"),
    }
    line = ", ".join(f"coalesce({kinds[k].format(x=x)}, 'NA')" for x, k in cells.items())
    return f"SELECT '{header}' AS line UNION ALL SELECT concat_ws(',', {line}) FROM ({table})"


_SES = ("age_bucket", '"SEX"', "hhinc_harmonized", '"EDUC"')
_ROUNDTRIP = f"{_ON_PERSON} SELECT * FROM person"
_MERGED_COLUMNS = ", ".join(
    [f'"{c}", "{c}_hh"' for c in ("NUMPREC", "GQ", "HHWT", "room", "bedroom")]
    + [
        "n_multifam, n_multifam_hh, is_multifam, is_multifam_hh, hh_size, hhinc_harmonized",
        "n_adults, n_children",
        ", ".join(_COMPONENTS),
    ]
)

ORACLES: dict[str, str] = {
    "select_samples": f"""{_ON_PERSON} SELECT * FROM person
WHERE "YEAR" IN (1960, 1970, 1980, 1990) OR "YEAR" BETWEEN 2000 AND 2023""",
    "write_read_roundtrip": _ROUNDTRIP,
    "published_csv_roundtrip": f"{_ON_CODED} " + _csv(
        f"""SELECT "YEAR", {_COUNTS.format(w='"PERWT"')},
  sum("PERWT" * "NUMPREC") / sum("PERWT") AS weighted_mean
FROM coded WHERE {_HH_POPULATION} GROUP BY "YEAR" """,
        "YEAR,weighted_count,count,weighted_mean",
        {'"YEAR"': "number", "weighted_count": "number", "count": "number", "weighted_mean": "six"},
    ),
    "published_csv_quoted_roundtrip": _csv(
        f"{_ON_CODED},"
        + _share("race_eth", "c.is_multifam AND c.race_eth IN ('White', 'Black', 'Hispanic')"),
        '"is_multifam","YEAR","race_eth","weighted_count","count","percent"',
        {"is_multifam": "boolean", '"YEAR"': "number", "race_eth": "text",
         "weighted_count": "number", "count": "number", "percent": "six"},
        quote='"',
    ),
    "ingest_fixed_width": _ROUNDTRIP,
    "recode_family_count": _recode("n_multifam"),
    "recode_is_multifam": _recode("is_multifam"),
    "recode_rooms": _recode("room"),
    "recode_bedrooms": _recode("bedroom"),
    "persons_per_bedroom": _recode("ppbr"),
    "recode_age_bucket": _recode("age_bucket"),
    "recode_race_eth": _recode("is_hispan", "race_bucket", "race_eth"),
    "income_harmonized": _recode("CAST(inctot_harmonized AS DOUBLE) AS inctot_harmonized"),
    "household_rollup": f"{_ON_HOUSEHOLD} SELECT * FROM household",
    "person_with_household": f"{_ON_MERGED} SELECT {_PERSON_KEY}, {_MERGED_COLUMNS} FROM merged",
    "household_rollup_hot": f"{_with(_HOT_PERSON, _CODED, _HOUSEHOLD)} SELECT * FROM household",
    "person_with_household_hot": f"""{_with(_HOT_PERSON, _CODED, _HOUSEHOLD, _MERGED)}
SELECT {_PERSON_KEY}, {_MERGED_COLUMNS} FROM merged""",
    "build_stage_tables": f"{_ON_MERGED} SELECT {_PERSON_KEY}, {_MERGED_COLUMNS} FROM merged",
    "append_year": f"{_ON_MERGED} SELECT {_PERSON_KEY}, {_MERGED_COLUMNS} FROM merged",
    "colocated_merge": f"{_ON_MERGED} SELECT {_PERSON_KEY}, {_MERGED_COLUMNS} FROM merged",
    "row_count_checks": f"""{_ON_MERGED}
SELECT 1 AS step_number, 'person recode' AS step, (SELECT count(*) FROM person) AS expected,
  (SELECT count(*) FROM coded) AS actual
UNION ALL SELECT 2, 'unique person key', (SELECT count(*) FROM person),
  (SELECT count(*) FROM (SELECT DISTINCT {_PERSON_KEY} FROM person))
UNION ALL SELECT 3, 'household rollup',
  (SELECT count(*) FROM (SELECT DISTINCT "YEAR", "SERIAL" FROM person)),
  (SELECT count(*) FROM household)
UNION ALL SELECT 4, 'person with household', (SELECT count(*) FROM coded),
  (SELECT count(*) FROM merged)""",
    "crosstab_count": f"""{_ON_CODED}
SELECT CAST(least("NUMPREC", 6) AS INTEGER) AS size_group, race_eth,
  {_COUNTS.format(w='"PERWT"')} FROM coded GROUP BY ALL""",
    "crosstab_mean": f"""{_ON_CODED}
SELECT "YEAR", race_eth, {_COUNTS.format(w='"PERWT"')},
  sum("PERWT" * "AGE") / sum("PERWT") AS weighted_mean
FROM coded GROUP BY "YEAR", race_eth""",
    "crosstab_percent": f"""{_ON_CODED},{_percent(
        'coded', '"PERWT"', 'n_multifam, race_eth, age_bucket', 'race_eth, age_bucket',
        'TRUE', 'TRUE')}""",
    "hhsize_by_year": f"""{_ON_CODED}
SELECT "YEAR", {_COUNTS.format(w='"PERWT"')},
  sum("PERWT" * "NUMPREC") / sum("PERWT") AS weighted_mean
FROM coded WHERE {_HH_POPULATION} GROUP BY "YEAR" """,
    "multifam_share_by_year": f"{_ON_CODED},{_share('', 'is_multifam')}",
    "multifam_share_by_race": f"""{_ON_CODED},{_share(
        'race_eth', "c.is_multifam AND c.race_eth IN ('White', 'Black', 'Hispanic')")}""",
    "multifam_share_by_age": f"{_ON_CODED},{_share('age_bucket', 'c.is_multifam')}",
    "multifam_share_tables": f"{_ON_CODED} {_SHARE_TABLES}",
    "gq_share_by_race": f"""{_ON_CODED}, placed AS (SELECT *, "GQ" >= 3 AS in_gq FROM coded),{
        _percent('placed', '"PERWT"', 'in_gq, "YEAR", race_eth', '"YEAR", race_eth', 'TRUE',
                 "c.in_gq AND c.race_eth IN ('White', 'Black', 'AAPI', 'Hispanic', 'AIAN')")}""",
    "multifam_hh_count": f"""{_ON_HOUSEHOLD}
SELECT n_multifam, "YEAR", {_COUNTS.format(w='"HHWT"')} FROM household
WHERE {_HH_POPULATION} AND is_multifam GROUP BY n_multifam, "YEAR" """,
    "multifam_hh_percent": f"""{_ON_HOUSEHOLD},{_percent(
        'household', '"HHWT"', 'n_multifam, "YEAR"', '"YEAR"',
        f'{_HH_POPULATION} AND is_multifam', 'TRUE')}""",
    "hh_component_mean": f"""{_ON_HOUSEHOLD},{_COMPONENT_TABLE}
SELECT "YEAR", n_child FROM components""",
    "hh_components": f"{_ON_HOUSEHOLD},{_COMPONENT_TABLE} SELECT * FROM components",
    "hh_components_long": f"{_ON_HOUSEHOLD},{_COMPONENT_TABLE} {_LONG}",
    "hh_components_normalized": f"""{_ON_HOUSEHOLD},{_COMPONENT_TABLE},{_NORMALIZED_TABLE}
SELECT * FROM normalized""",
    "hh_components_normalized_long": f"""{_ON_HOUSEHOLD},{_COMPONENT_TABLE},{_NORMALIZED_TABLE}
{_NORMALIZED_LONG}""",
    "multifam_by_children": _children(
        8, "model", "TRUE", "avg(CAST(is_multifam AS INTEGER)) AS p_multifam"
    ),
    "multifam_by_children_cap2": _children(
        2, "model", "TRUE", "avg(CAST(is_multifam AS INTEGER)) AS p_multifam"
    ),
    "rent_burden": f"{_ON_MODEL} SELECT {_PERSON_KEY}, rent_burden FROM renter",
    "rent_burden_by_children": _children(
        8, "renter", _BURDEN_0_2, "round(avg(rent_burden), 6) AS mean_rent_burden"
    ),
    "rent_burden_bands": _band_counts("renter", _BY_BURDEN, _BURDEN_0_2),
    "rent_bands": _band_counts("renter", _BY_RENT, "TRUE"),
    "rent_burden_histogram": f"""{_ON_MODEL},
bin AS (
  SELECT band_rank, hi + 0.000000005::DOUBLE AS hi,
    lag(hi + 0.000000005::DOUBLE) OVER (ORDER BY band_rank) AS lo
  FROM burden_band
)
SELECT band_rank, count("SERIAL") AS n,
  printf('%.2f–%.2f', (band_rank - 1) / 20.0::DOUBLE, band_rank / 20.0::DOUBLE) AS band
FROM bin LEFT JOIN (SELECT * FROM renter WHERE rent_burden_13 > 0 AND rent_burden_13 < 2) r
  ON rent_burden_13 <= hi AND (lo IS NULL OR rent_burden_13 > lo)
GROUP BY band_rank""",
    "rent_burden_histogram_of_range": f"""{_ON_MODEL},
burden AS (
  SELECT rent_burden_13 AS x FROM renter
  WHERE hhinc_harmonized >= 60000 AND rent_burden_13 > 0 AND rent_burden_13 < 2
),
cell AS (
  SELECT lo, hi, (hi - lo) / 50 AS w, pow(10::DOUBLE, floor(log10((hi - lo) / 50))) AS p
  FROM (SELECT min(x) AS lo, max(x) AS hi FROM burden)
),
unit AS (
  SELECT lo, hi, CASE WHEN 2 * p - w >= 1.5::DOUBLE * (w - p) THEN p
    WHEN 5 * p - w >= 2.75::DOUBLE * (w - 2 * p) THEN 2 * p
    WHEN 10 * p - w >= 1.5::DOUBLE * (w - 5 * p) THEN 5 * p ELSE 10 * p END AS u
  FROM cell
),
bin AS (
  SELECT u, unnest(range(CAST(floor(lo / u + 1e-10) AS BIGINT), CAST(ceil(hi / u - 1e-10) AS BIGINT))) AS k FROM unit
),
edge AS (
  SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS band_rank, k * u AS low, (k + 1) * u AS high, 1e-7 * u AS eps
  FROM bin
)
SELECT band_rank, round(low, 9) AS low, round(high, 9) AS high, count(x) AS n
FROM edge LEFT JOIN burden
  ON x <= high + eps AND (x > low + eps OR (band_rank = 1 AND x >= low - eps))
GROUP BY band_rank, low, high""",
    "rent_burden_by_city": _rent_table("city", '"YEAR" = 2023'),
    "rent_burden_by_city_all_years": _rent_table("city", "TRUE"),
    "rent_burden_one_city": _rent_table("city", "TRUE", 'c."CITY" = 5350'),
    "low_income_rent_burden": _rent_table("low", '"YEAR" = 2023'),
    "low_income_rent_burden_all_years": _rent_table("low", "TRUE"),
    "rent_per_family_bands": _rent_table("family", '"YEAR" = 2023'),
    "rent_per_family_bands_all_years": _rent_table("family", "TRUE"),
    "ppbr_by_rent_burden": f"""{_ON_MODEL}
SELECT band, band_rank, "YEAR", {_COUNTS.format(w='"HHWT_hh"')},
  round(sum("HHWT_hh" * ppbr) / sum("HHWT_hh"), 6) AS weighted_mean
FROM renter {_BY_BURDEN}
WHERE ppbr > 0 AND rent_burden > 0 AND rent_burden < 1 AND "YEAR" IN (2000, 2010, 2020, 2023)
GROUP BY band, band_rank, "YEAR" HAVING count(*) >= 5""",
    "lpm_base": _lpm_fit((), 7),
    "lpm_child": _lpm_fit(("n_child",), 8),
    "lpm_demo": _lpm_fit(("age_bucket", '"SEX"'), 11),
    "lpm_ses": _lpm_fit(_SES, 13),
    "lpm_ses_terms": _lpm_fit(_SES, 13, all_terms=True),
    "lpm_ses_added_years": _lpm_fit(_SES, 13),
    "lpm_ses_orthogonal": _lpm_fit(_SES, 13),
    "lpm_shifted_control": _lpm_fit(("shifted_rent",), 8, all_terms=True, shift="1000000"),
    "lpm_sufficient_stats": _lpm_stats(),
}

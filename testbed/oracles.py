"""Equivalent SQL of the registered queries for an independent engine."""

from __future__ import annotations

# Named table expressions. Each one may use the ones listed as its needs.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": (
        (),
        """SELECT p_type AS scenario, l_suppkey AS id, CAST(l_suppkey % 10 AS INTEGER) AS x,
                  CAST(l_suppkey // 10 AS INTEGER) AS y, l_shipdate AS ts, l_quantity AS precip,
                  l_extendedprice / 1000 AS gpp
           FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "scen": (
        (),
        """SELECT scenario, 'D' || CAST(1 + o // 2 AS VARCHAR) AS drought_intensity,
                  (['N', 'W3', 'W2', 'W1'])[1 + o % 4] AS recovery_intensity,
                  CAST(1 + o % 3 AS INTEGER) AS drought_duration,
                  'D' || CAST(1 + o // 2 AS VARCHAR) || '-' || (['N', 'W3', 'W2', 'W1'])[1 + o % 4]
                      || '-' || CAST(1 + o % 3 AS VARCHAR) AS scen_code
           FROM (SELECT scenario, row_number() OVER (ORDER BY scenario) - 1 AS o
                 FROM (SELECT DISTINCT p_type AS scenario FROM part))""",
    ),
    "cells": (
        (),
        """SELECT s_suppkey AS id, CAST(s_suppkey % 10 AS INTEGER) AS x,
                  CAST(s_suppkey // 10 AS INTEGER) AS y, s_suppkey / 10 - 10 AS lat,
                  s_suppkey / 20 - 40 AS lon, CASE WHEN s_suppkey % 5 = 0 THEN 6 ELSE 7 END AS soil_type,
                  CAST(7 + s_suppkey % 4 AS INTEGER) AS veg_type
           FROM supplier""",
    ),
    "panel": (
        ("obs",),
        """SELECT scenario, x, y, CAST(year(ts) AS INTEGER) AS year, sum(precip) AS precip,
                  sum(gpp) AS gpp
           FROM obs GROUP BY ALL""",
    ),
    "enriched": (
        ("panel", "scen", "cells"),
        """SELECT p.*, s.* EXCLUDE (scenario), c.* EXCLUDE (x, y)
           FROM panel p LEFT JOIN scen s USING (scenario) LEFT JOIN cells c USING (x, y)""",
    ),
    "labelled": (
        ("panel", "scen"),
        """SELECT p.*, CASE WHEN year < 1995 THEN NULL WHEN year <= 1996 THEN 'baseline'
                            WHEN year <= 1996 + drought_duration THEN 'impact'
                            WHEN year <= 1998 + drought_duration THEN 'recovery'
                            ELSE 'normal' END AS period,
                  CASE WHEN year < 1995 THEN NULL WHEN year <= 1996 THEN year - 1995
                       WHEN year <= 1996 + drought_duration THEN year - 1997
                       WHEN year <= 1998 + drought_duration THEN year - 1997 - drought_duration
                       ELSE year - 1999 - drought_duration END AS phase_year
           FROM panel p LEFT JOIN scen s USING (scenario)""",
    ),
    "long": (
        ("labelled",),
        """SELECT scenario, x, y, period, year, 'gpp' AS variable, gpp AS value FROM labelled
           UNION ALL
           SELECT scenario, x, y, period, year, 'precip', precip FROM labelled""",
    ),
    "k_base": (("long",), "SELECT scenario, x, y, variable, value AS s_to FROM long WHERE year = 1996"),
    "k_min": (
        ("long",),
        """SELECT scenario, x, y, variable, value AS s_ti1, year AS ti1
           FROM (SELECT *, row_number() OVER (PARTITION BY scenario, x, y, variable
                                              ORDER BY value, year) AS r
                 FROM long WHERE period = 'impact' AND value IS NOT NULL) WHERE r = 1""",
    ),
    "k_last": (
        ("long",),
        """SELECT scenario, x, y, variable, value AS s_ti2, year AS ti2
           FROM (SELECT *, row_number() OVER (PARTITION BY scenario, x, y, variable
                                              ORDER BY year DESC) AS r
                 FROM long WHERE period = 'impact') WHERE r = 1""",
    ),
    "k_first": (
        ("long",),
        """SELECT scenario, x, y, variable, value AS s_tr, year AS tr
           FROM (SELECT *, row_number() OVER (PARTITION BY scenario, x, y, variable ORDER BY year) AS r
                 FROM long WHERE period = 'recovery') WHERE r = 1""",
    ),
    "k_thr": (
        ("long", "k_base"),
        """SELECT scenario, x, y, variable, value AS s_tr, year AS tr
           FROM (SELECT l.*, row_number() OVER (PARTITION BY scenario, x, y, variable ORDER BY year) AS r
                 FROM long l JOIN k_base USING (scenario, x, y, variable)
                 WHERE period = 'recovery' AND value >= CAST(0.95 AS DOUBLE) * s_to) WHERE r = 1""",
    ),
    "k_stab": (
        ("long",),
        """SELECT scenario, x, y, variable, stddev_samp(value) / nullif(avg(value), 0) AS stability
           FROM long WHERE period IN ('baseline', 'impact', 'recovery') GROUP BY ALL""",
    ),
}


def _metrics(recovery: str) -> str:
    bad = "(coalesce(s_tr < s_ti2, false) OR coalesce(s_ti1 > s_to, false) OR coalesce(s_ti2 > s_to, false))"

    def valid(expr: str, name: str) -> str:
        return f"CASE WHEN NOT {bad} THEN {expr} END AS {name}"

    return f"""SELECT scenario, x, y, variable, s_to, s_ti1, ti1, s_ti2, ti2, s_tr, tr,
               {valid('stability', 'stability')},
               {valid('1 - s_ti1 / nullif(s_to, 0)', 'impact')},
               {valid('s_tr / nullif(s_ti2, 0)', 'recovery')},
               {valid('(s_tr - s_ti2) / nullif(s_to, 0)', 'recovery_base')},
               {valid('(s_tr - s_ti2) / nullif(s_to - s_ti1, 0)', 'recovery_impact')}
        FROM k_base FULL JOIN k_min USING (scenario, x, y, variable)
             FULL JOIN k_last USING (scenario, x, y, variable)
             FULL JOIN {recovery} USING (scenario, x, y, variable)
             FULL JOIN k_stab USING (scenario, x, y, variable)"""


VARIABLES = ("gpp", "precip")
METRICS = ("stability", "impact", "recovery", "recovery_base", "recovery_impact")
WIDE = [f"{v}_{m}" for v in VARIABLES for m in METRICS]
PAIRS = [
    ("gpp_recovery_base", "gpp_impact"),
    ("gpp_recovery_impact", "gpp_impact"),
    ("gpp_impact", "precip_impact"),
    ("gpp_recovery_base", "precip_recovery_base"),
    ("gpp_recovery_impact", "precip_recovery_impact"),
    ("gpp_stability", "precip_stability"),
]
METRIC_OF = dict(
    zip([f"{d} ~ {i}" for d, i in PAIRS[2:]], ("Impact", "Recovery[b]", "Recovery[i]", "Stability"), strict=True)
)
SOURCES = ("view", "click", "purchase", "signup", "error")
KM = ("k_base", "k_min", "k_last", "k_stab")

_wide_cols = ", ".join(
    f"max(CASE WHEN variable = '{v}' THEN {m} END) AS {v}_{m}" for v in VARIABLES for m in METRICS
)
_metric_case = "CASE formula " + " ".join(f"WHEN '{f}' THEN '{m}'" for f, m in METRIC_OF.items()) + " END"
_shown = "formula IN (" + ", ".join(f"'{f}'" for f in METRIC_OF) + ")"
_pair_union = " UNION ALL ".join(
    f"SELECT id, scenario, sample_id, veg_type, '{d} ~ {i}' AS formula, {d} AS y, {i} AS x FROM sampled"
    for d, i in PAIRS
)
_wide_long = " UNION ALL ".join(
    f"SELECT id, scenario, veg_type, '{c}' AS variable, {c} AS value FROM wide" for c in WIDE
)
_complete = " AND ".join(f"{c} IS NOT NULL" for c in WIDE)


def _random(*parts: str) -> str:
    """60 bits of an md5 hash as a BIGINT."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def _resample(src: str, strata: str, order: str, n: int, reps: int) -> str:
    """Table expressions ``numbered`` (rows with positions) and ``taken`` (positions of each replicate).

    A number is split over two halves; six rounds swap them and add a hash of one to the other.
    """
    step = f"SELECT * EXCLUDE (l, r), r AS l, (l + {_random('2021', 'k', strata, '{0}', 'r')}) % {{1}} AS r FROM ({{2}})"
    rows = f"""SELECT z.*, CAST(k AS INTEGER) AS sample_id, k, j, j % half AS l, j // half AS r
               FROM halves z CROSS JOIN generate_series(1, {reps}) a(k)
               CROSS JOIN LATERAL (SELECT unnest(range(least(size, {n}) + half * other - size)) AS j) b"""
    for i in range(1, 7):
        rows = step.format(i, "half" if i % 2 else "other", rows)
    return f"""numbered AS (
              SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {order}) - 1 AS pos,
                     count(*) OVER (PARTITION BY {strata}) AS size FROM {src}),
            halves AS (
              SELECT *, (size + half - 1) // half AS other FROM (
                SELECT DISTINCT {strata}, size, CAST(least(64, ceil(sqrt(size))) AS BIGINT) AS half FROM numbered)),
            taken AS (
              SELECT {strata}, sample_id, r * half + l AS pos FROM ({rows}) WHERE r * half + l < size
              QUALIFY row_number() OVER (PARTITION BY {strata}, sample_id ORDER BY j) <= least(size, {n}))"""


PARTS |= {
    "found": ((*KM, "k_first"), _metrics("k_first")),
    "found_thr": ((*KM, "k_thr"), _metrics("k_thr")),
    "found_enr": (
        ("found", "enriched"),
        """SELECT f.*, d.* EXCLUDE (scenario, x, y) FROM found f JOIN (
             SELECT DISTINCT scenario, x, y, lat, lon, id, scen_code, drought_intensity,
                    recovery_intensity, drought_duration, soil_type, veg_type FROM enriched) d
           USING (scenario, x, y)""",
    ),
    "coh": (
        ("found_enr",),
        """SELECT * REPLACE ((['Open Shrublands', 'Woody Savannas', 'Savannas', 'Grasslands'])[veg_type - 6]
                             AS veg_type),
                  list_position(['W1', 'W2', 'W3', 'N'], recovery_intensity) AS recovery_order
           FROM found_enr
           WHERE impact > CAST(0.10 AS DOUBLE) AND veg_type BETWEEN 7 AND 10 AND soil_type = 7
             AND drought_duration <= 2""",
    ),
    "wide": (("coh",), f"SELECT id, scenario, veg_type, {_wide_cols} FROM coh GROUP BY ALL"),
    "wide_long": (("wide",), _wide_long),
    "series": (
        (),
        """SELECT u.unit AS Year, s.source AS Source, v.value AS Precip
           FROM (SELECT DISTINCT CAST(day(ts) AS INTEGER) AS unit FROM events) u
           CROSS JOIN (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS source) s
           LEFT JOIN (SELECT CAST(day(ts) AS INTEGER) AS unit, event_type, sum(value) AS value
                      FROM events GROUP BY ALL) v ON v.unit = u.unit AND v.event_type = s.source""",
    ),
    "sub": (
        (),
        """SELECT u.unit AS Year, u.part AS Month, s.source AS Source, v.value AS Precip
           FROM (SELECT DISTINCT CAST(day(ts) AS INTEGER) AS unit, CAST(hour(ts) // 6 AS INTEGER) AS part
                 FROM events) u
           CROSS JOIN (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS source) s
           LEFT JOIN (SELECT CAST(day(ts) AS INTEGER) AS unit, CAST(hour(ts) // 6 AS INTEGER) AS part,
                             event_type, sum(value) AS value FROM events GROUP BY ALL) v
             ON v.unit = u.unit AND v.part = u.part AND v.event_type = s.source""",
    ),
    "cuts": (
        ("series",),
        """SELECT quantile_cont(Precip, [0.05, 0.40, 0.60, 0.95]) AS q
           FROM series WHERE Source IN ('view', 'click')""",
    ),
    "cls": (
        ("series", "cuts"),
        """SELECT Year, Source, Precip,
                  CASE WHEN Precip >= q[1] AND Precip < q[2] THEN 'Dry'
                       WHEN Precip >= q[2] AND Precip <= q[3] THEN 'Normal'
                       WHEN Precip > q[3] AND Precip <= q[4] THEN 'Wet' END AS Condition
           FROM series CROSS JOIN cuts""",
    ),
    "csum": (
        ("cls",),
        """SELECT Condition, min(Precip) AS min, avg(Precip) AS mean, max(Precip) AS max FROM cls
           WHERE Source IN ('view', 'click') AND Condition IS NOT NULL GROUP BY Condition""",
    ),
    "dist": (
        ("cls", "csum"),
        """SELECT Year, Condition, Precip AS reference,
                  CASE WHEN Condition <> 'Normal' THEN abs(Precip - min) END AS Min_Dif,
                  abs(Precip - mean) AS Mean_Dif,
                  CASE WHEN Condition <> 'Normal' THEN abs(Precip - max) END AS Max_Dif
           FROM cls JOIN csum USING (Condition) WHERE Source = 'purchase' AND Precip IS NOT NULL""",
    ),
    "targets": (
        ("csum",),
        """SELECT Class, Condition, Metric, Precip FROM (
             SELECT Condition, 'Min' AS Metric, min AS Precip FROM csum
             UNION ALL SELECT Condition, 'Mean', mean FROM csum
             UNION ALL SELECT Condition, 'Max', max FROM csum)
           JOIN (VALUES ('D1', 'Dry', 'Min'), ('D2', 'Dry', 'Mean'), ('D3', 'Dry', 'Max'),
                        ('N', 'Normal', 'Mean'), ('W1', 'Wet', 'Min'), ('W2', 'Wet', 'Mean'),
                        ('W3', 'Wet', 'Max')) t(Class, Condition, Metric) USING (Condition, Metric)""",
    ),
    "chosen": (
        ("dist", "targets"),
        """SELECT Class, Year FROM (
             SELECT Condition, Metric, Year, row_number() OVER (PARTITION BY Condition, Metric
                                                                ORDER BY dif, Year) AS r
             FROM (SELECT Condition, Year, 'Min' AS Metric, Min_Dif AS dif FROM dist
                   UNION ALL SELECT Condition, Year, 'Mean', Mean_Dif FROM dist
                   UNION ALL SELECT Condition, Year, 'Max', Max_Dif FROM dist) WHERE dif IS NOT NULL)
           JOIN targets USING (Condition, Metric) WHERE r = 1""",
    ),
    "parts": (
        ("sub", "cls"),
        """SELECT s.Source, s.Year, s.Month, s.Precip, c.Condition
           FROM sub s JOIN cls c USING (Source, Year)""",
    ),
    "stations": (
        ("cls",),
        """SELECT Precip FROM cls WHERE Source IN ('view', 'click') AND Precip IS NOT NULL
             AND Condition IS NOT NULL""",
    ),
    "sampled": (
        ("wide",),
        f"""WITH {_resample('wide', 'veg_type', 'id, scenario', 10, 20)}
            SELECT numbered.* EXCLUDE (pos, size), taken.sample_id
            FROM numbered JOIN taken USING (veg_type, pos)""",
    ),
    "pairs": (("sampled",), _pair_union),
    "cpairs": (("pairs",), "SELECT * FROM pairs WHERE y IS NOT NULL AND x IS NOT NULL"),
    "coefs": (
        ("cpairs",),
        """SELECT formula, sample_id, veg_type,
                  CASE WHEN regr_sxx(y, x) > 0 THEN regr_intercept(y, x) END AS intercept,
                  CASE WHEN regr_sxx(y, x) > 0 THEN regr_slope(y, x) END AS slope,
                  CAST(regr_count(y, x) AS BIGINT) AS n
           FROM cpairs GROUP BY ALL""",
    ),
    "resids": (
        ("cpairs", "coefs"),
        """SELECT p.*, intercept + slope * x AS fitted, y - (intercept + slope * x) AS resid
           FROM cpairs p JOIN coefs USING (formula, sample_id, veg_type)""",
    ),
    "clong": (
        ("coefs",),
        f"""SELECT sample_id, veg_type, {_metric_case} AS metric, 'Intercept' AS term,
                   intercept AS estimate FROM coefs WHERE {_shown}
            UNION ALL
            SELECT sample_id, veg_type, {_metric_case}, 'Slope', slope FROM coefs WHERE {_shown}""",
    ),
    "rmed": (
        ("cpairs",),
        f"""SELECT sample_id, veg_type, median(y / nullif(x, 0)) AS median, {_metric_case} AS metric
            FROM cpairs WHERE {_shown} GROUP BY formula, sample_id, veg_type""",
    ),
}


def _order(names: tuple[str, ...]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        for need in PARTS[name][0]:
            visit(need)
        if name not in done:
            done.append(name)

    for n in names:
        visit(n)
    return done


def sql(body: str, *needs: str) -> str:
    ctes = ",\n".join(f'"{n}" AS ({PARTS[n][1]})' for n in _order(needs))
    return f"WITH {ctes}\n{body}" if ctes else body


def r(columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


_states = f"scenario, x, y, variable, {r('s_to s_ti1')}, ti1, {r('s_ti2')}, ti2, {r('s_tr')}, tr"
_found = f"{_states}, {r(' '.join(METRICS))}"
_dims = (
    f"{r('lat lon')}, id, scen_code, drought_intensity, recovery_intensity, drought_duration, "
    "soil_type, veg_type"
)


def _box(src: str, by: str, value: str) -> str:
    """Boxplot numbers of ``src`` by the columns ``by``."""
    return f""", q AS (SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
                          quantile_cont({value}, 0.75) AS q3 FROM {src} GROUP BY ALL),
             f AS (SELECT {src}.*, q1, median, q3,
                          {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
                   FROM {src} JOIN q USING ({by}))
        SELECT {by}, {r('q1 median q3')}, count(*) AS n, round(avg({value}), 8) AS mean,
               round(least(q1, min({value}) FILTER (WHERE inside)), 8) AS whisker_low,
               round(greatest(q3, max({value}) FILTER (WHERE inside)), 8) AS whisker_high,
               count(*) FILTER (WHERE NOT inside) AS outliers
        FROM f GROUP BY {by}, q1, median, q3"""


def _hex(src: str, by: str, span_x: str, span_y: str) -> str:
    """Hexagon counts of ``src`` (columns px, py) with 30 bins per axis."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f""", m AS (SELECT *, min(px) OVER ({part}) AS x0, max(px) OVER ({part}) AS x1,
                          min(py) OVER ({part}) AS y0, max(py) OVER ({part}) AS y1 FROM {src}),
             w AS (SELECT *, ({span_x}) / 30 AS xw, ({span_y}) / 30 AS yw FROM m),
             g AS (SELECT *, floor(x0 / xw) * xw - CAST(1e-6 AS DOUBLE) AS xb,
                          floor(y0 / yw) * yw - CAST(1e-6 AS DOUBLE) AS yb FROM w),
             s AS (SELECT *, (px - xb) / xw AS u, (py - yb) / (yw * sqrt(3)) AS v FROM g),
             d AS (SELECT *, pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) AS d1,
                          pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS d2 FROM s),
             c AS (SELECT *, CASE WHEN d1 <= d2 THEN floor(u + 0.5) ELSE floor(u) + 0.5 END AS i,
                          CASE WHEN d1 <= d2 THEN floor(v + 0.5) ELSE floor(v) + 0.5 END AS j FROM d)
        SELECT {b}round(xb + i * xw, 6) AS x, round(yb + j * yw * sqrt(3), 6) AS y, count(*) AS count
        FROM c GROUP BY {b}xb, xw, yb, yw, i, j"""


def _hist(src: str, by: str, bins: int, digits: int) -> str:
    """Histogram of ``src`` (column v)."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f""", m AS (SELECT *, min(v) OVER ({part}) AS lo, max(v) OVER ({part}) AS hi FROM {src}),
             w AS (SELECT *, (hi - lo) / {bins - 1} AS w FROM m),
             s AS (SELECT *, floor((lo - w / 2) / w) * w + w / 2 AS o FROM w),
             i AS (SELECT *, greatest(ceil((v - o) / w - CAST(1e-8 AS DOUBLE)) - 1, 0) AS i FROM s)
        SELECT {b}round(o + i * w, {digits}) AS xmin, round(o + i * w + w, {digits}) AS xmax,
               count(*) AS count FROM i GROUP BY {b}o, w, i"""


def _density(src: str, by: str, panel: str, value: str) -> str:
    """Binned kernel density of ``src`` on 64 points, bandwidth shared by ``panel``."""
    return f""", v AS (SELECT {by}, {value} AS v FROM {src} WHERE {value} IS NOT NULL),
             g AS (SELECT {by}, count(*) AS n, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1,
                          quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.025) AS low,
                          quantile_cont(v, 0.975) AS high, min(v) AS mn, max(v) AS mx FROM v GROUP BY ALL),
             p AS (SELECT *, avg(0.9 * coalesce(nullif(least(sd, (q3 - q1) / CAST(1.34 AS DOUBLE)), 0), nullif(sd, 0),
                                                   nullif(abs(mn), 0), 1) * pow(n, CAST(-0.2 AS DOUBLE)))
                               OVER (PARTITION BY {panel}) AS bw,
                          min(mn) OVER (PARTITION BY {panel}) AS lo,
                          max(mx) OVER (PARTITION BY {panel}) AS hi FROM g),
             d AS (SELECT *, lo - 3 * bw AS f, (hi + 3 * bw - (lo - 3 * bw)) / 63 AS d FROM p),
             a AS (SELECT d.*, (v - f) / d AS place FROM v JOIN d USING ({by})),
             w AS (SELECT {by}, n, bw, f, d, low, high, i, sum(w) AS w FROM (
                     SELECT *, floor(place) AS i, 1 - place + floor(place) AS w FROM a
                     UNION ALL SELECT *, floor(place) + 1, place - floor(place) FROM a) GROUP BY ALL)
        SELECT {by}, CAST(point AS INTEGER) AS point, round(f + point * d, 6) AS x,
               round(sum(w * exp(-0.5 * pow((point - i) * d / bw, 2))) / sqrt(2 * pi()) / n / bw, 6) AS density,
               round(low, 6) AS low, round(high, 6) AS high
        FROM w CROSS JOIN generate_series(0, 63) t(point)
        GROUP BY {by}, n, bw, f, d, low, high, point"""


def _line(src: str, by: str) -> str:
    """Least-squares line with its 95 % band for ``src`` (columns px, py) on 80 points."""
    z = 1.959963984540054
    # tabled 97.5 % points of Student's distribution for 1 to 9 degrees of freedom; fixed values
    small = [12.7062047364, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511,
             2.3646242516, 2.3060041352, 2.2621571628]
    g = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    series = f"(CAST({z!r} AS DOUBLE)" + "".join(
        f" + CAST({c!r} AS DOUBLE) / pow(n - 2, {k})" for k, c in enumerate(g, start=1)
    ) + ")"
    t = f"(CASE WHEN n < 12 THEN CAST(({small!r})[CAST(n AS BIGINT) - 2] AS DOUBLE) ELSE {series} END)"
    return f""", s AS (SELECT {by}, regr_slope(py, px) AS b, regr_intercept(py, px) AS a, min(px) AS lo,
                          max(px) AS hi, CAST(count(*) AS DOUBLE) AS n, avg(px) AS mx,
                          regr_sxx(py, px) AS sxx, regr_syy(py, px) AS syy, regr_sxy(py, px) AS sxy
                   FROM {src} GROUP BY ALL HAVING regr_sxx(py, px) > 0),
             l AS (SELECT *, lo + (hi - lo) * point / 79 AS gx
                   FROM s CROSS JOIN generate_series(0, 79) t(point)),
             e AS (SELECT *, a + b * gx AS fit,
                          CASE WHEN n > 2 THEN {t} * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)
                               * (1 / n + pow(gx - mx, 2) / sxx)) END AS half FROM l)
        SELECT {by}, CAST(point AS INTEGER) AS point, round(gx, 6) AS x, round(fit, 6) AS fit,
               round(fit - half, 6) AS low, round(fit + half, 6) AS high FROM e"""


_summary = """SELECT variable, count(value) AS n, min(value) AS min, avg(value) AS mean,
                     median(value) AS median, max(value) AS max, stddev_samp(value) AS sd
              FROM wide_long WHERE value IS NOT NULL GROUP BY variable"""

ORACLES: dict[str, str] = {
    "yearly_missing": sql(
        """SELECT scenario, x, y, CAST(date_trunc('year', time) AS DATE) AS time,
                  round(coalesce(sum(precip), 0), 8) AS precip,
                  round(coalesce(sum(CASE WHEN abs(gpp) > 20 THEN NULL ELSE gpp END), 0), 8) AS gpp
           FROM (SELECT scenario, x, y, date_trunc('month', ts) AS time,
                        sum(precip) AS precip, sum(gpp) AS gpp FROM obs GROUP BY ALL) GROUP BY ALL""",
        "obs",
    ),
    "nested_panel": sql(f"SELECT scenario, x, y, year, {r('precip gpp')} FROM panel", "panel"),
    "station_sources": """SELECT event_type, round(sum(value), 8) AS value FROM events
        WHERE event_type NOT LIKE '%c%' GROUP BY event_type""",
    "grid_file_years": """SELECT DISTINCT 'scen_' || CAST(user_id % 49 AS VARCHAR) AS scenario,
        CAST(year(ts) AS INTEGER) AS year FROM events""",
    "ecdf_prices": """SELECT l_extendedprice AS price, round(max(n) / (SELECT count(*) FROM lineitem), 8) AS share
        FROM (SELECT l_extendedprice, count(*) OVER (ORDER BY l_extendedprice) AS n FROM lineitem) GROUP BY ALL""",
    "period_labels": sql("SELECT scenario, x, y, year, period, CAST(phase_year AS INTEGER) AS phase_year FROM labelled", "labelled"),
    "baseline": sql(f"SELECT scenario, x, y, variable, {r('s_to')} FROM k_base", "k_base"),
    "impact_min": sql(f"SELECT scenario, x, y, variable, {r('s_ti1')}, ti1 FROM k_min", "k_min"),
    "impact_last": sql(f"SELECT scenario, x, y, variable, {r('s_ti2')}, ti2 FROM k_last", "k_last"),
    "recovery_first": sql(f"SELECT scenario, x, y, variable, {r('s_tr')}, tr FROM k_first", "k_first"),
    "recovery_threshold": sql(f"SELECT scenario, x, y, variable, {r('s_tr')}, tr FROM k_thr", "k_thr"),
    "stability": sql(f"SELECT scenario, x, y, variable, {r('stability')} FROM k_stab", "k_stab"),
    "metrics": sql(f"SELECT {_found} FROM found", "found"),
    "metrics_threshold": sql(f"SELECT {_found} FROM found_thr", "found_thr"),
    "metrics_any_length": sql(f"SELECT {_found} FROM found_thr", "found_thr"),
    "annual_file": sql(f"SELECT Year, Source, {r('Precip')} FROM series", "series"),
    "schedule_file": """SELECT 'scen_' || lpad(CAST(user_id % 49 + 1 AS VARCHAR), 2, '0') AS scen, """
    + ", ".join(
        f"CAST(max(CASE WHEN event_id % 7 = {i} THEN day(ts) END) AS INTEGER) AS X{i + 1}" for i in range(7)
    )
    + " FROM events GROUP BY 1",
    "panel_written": sql(
        """SELECT scenario, x, y, year, round(precip, 8) AS precip,
                  round(CASE WHEN drought_duration = 2 THEN 2 * gpp ELSE gpp END, 8) AS gpp
           FROM panel JOIN scen USING (scenario)""",
        "panel",
        "scen",
    ),
    "grid_explode": """SELECT vec_id, label, CAST((i - 1) % 8 AS INTEGER) AS x,
                              CAST((i - 1) // 8 AS INTEGER) AS y, round(CAST(embedding[i] AS DOUBLE), 8) AS v
                       FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""",
    "grid_monthly": sql(
        """SELECT scenario, x, y, CAST(date_trunc('month', ts) AS DATE) AS time,
                  round(sum(precip), 8) AS precip, round(sum(gpp), 8) AS gpp FROM obs GROUP BY ALL""",
        "obs",
    ),
    "outlier_null": sql(
        """SELECT scenario, x, y, time, round(precip, 8) AS precip,
                  round(CASE WHEN abs(gpp) > 200 THEN NULL ELSE gpp END, 8) AS gpp
           FROM (SELECT scenario, x, y, CAST(date_trunc('month', ts) AS DATE) AS time,
                        sum(precip) AS precip, sum(gpp) AS gpp FROM obs GROUP BY ALL)""",
        "obs",
    ),
    "yearly_panel": sql(
        """SELECT scenario, x, y, CAST(date_trunc('year', time) AS DATE) AS time,
                  round(coalesce(sum(precip), 0), 8) AS precip,
                  round(coalesce(sum(CASE WHEN abs(gpp) > 200 THEN NULL ELSE gpp END), 0), 8) AS gpp
           FROM (SELECT scenario, x, y, date_trunc('month', ts) AS time,
                        sum(precip) AS precip, sum(gpp) AS gpp FROM obs GROUP BY ALL) GROUP BY ALL""",
        "obs",
    ),
    "cell_ids": sql("SELECT x, y, row_number() OVER (ORDER BY x, y) AS id FROM cells", "cells"),
    "cell_attributes": sql(
        """, c AS (SELECT * EXCLUDE (id), row_number() OVER (ORDER BY x, y) AS id FROM cells)
           SELECT id, x, y, round(lat, 8) AS lat, round(lon, 8) AS lon, soil_type, veg_type FROM
             (SELECT id, x, y, lat, lon FROM c WHERE x <> 5)
             FULL JOIN (SELECT id, x, y, soil_type FROM c WHERE x <> 3) USING (id, x, y)
             FULL JOIN (SELECT id, x, y, veg_type FROM c WHERE y % 2 = 0 OR x = 3) USING (id, x, y)""",
        "cells",
    ),
    "panel_enriched": sql(
        f"SELECT scenario, x, y, year, {r('precip gpp')}, {_dims} FROM enriched", "enriched"
    ),
    "design_panel": """WITH k AS (SELECT CAST(unnest(generate_series(1, 49)) AS INTEGER) AS k),
             d AS (SELECT 'scen_' || lpad(CAST(k AS VARCHAR), 2, '0') AS scenario,
                          CASE WHEN k = 1 THEN 'N' ELSE 'D' || CAST(1 + (k - 2) // 16 AS VARCHAR) END AS drought_intensity,
                          CASE WHEN k = 1 THEN 'N'
                               ELSE (['N', 'W3', 'W2', 'W1'])[1 + ((k - 2) // 4) % 4] END AS recovery_intensity,
                          CAST(CASE WHEN k = 1 THEN 0 ELSE 4 - (k - 2) % 4 END AS INTEGER) AS drought_duration FROM k)
        SELECT s.scenario, round(precip, 8) AS precip, drought_intensity, recovery_intensity, drought_duration,
               drought_intensity || '-' || recovery_intensity || '-' || CAST(drought_duration AS VARCHAR) AS scen_code
        FROM (SELECT 'scen_' || lpad(CAST(l_suppkey % 49 + 1 AS VARCHAR), 2, '0') AS scenario,
                     sum(l_quantity) AS precip FROM lineitem GROUP BY ALL) s LEFT JOIN d USING (scenario)""",
    "schedule_long": sql(
        """, e AS (SELECT CAST(user_id % 49 + 1 AS VARCHAR) AS k, CAST(event_id % 7 + 1 AS INTEGER) AS Time,
                          CAST(max(day(ts)) AS INTEGER) AS Year FROM events GROUP BY ALL),
             t AS (SELECT DISTINCT k FROM e),
             c AS (SELECT Year, min(Class) AS Class FROM chosen GROUP BY Year)
        SELECT 'Scen[' || lpad(k, 2, '0') || ']' AS Scen, CAST(s.i AS INTEGER) AS Time, e.Year, c.Class
        FROM t CROSS JOIN generate_series(1, 7) s(i)
        LEFT JOIN e ON e.k = t.k AND e.Time = s.i LEFT JOIN c ON c.Year = e.Year""".replace("t.k,", "k,").replace(
            "lpad(k,", "lpad(t.k,"
        ),
        "chosen",
    ),
    "series_long": sql(f"SELECT Year, Source, {r('Precip')} FROM series", "series"),
    "plot_series": sql(
        """SELECT make_date(Year, 1, 1) AS Year, Source, round(Precip, 8) AS Precip FROM series
           WHERE Year >= 3 AND Source <> 'error' AND Precip IS NOT NULL""",
        "series",
    ),
    "quantiles": sql(
        """SELECT n.quantile, n.probability, round(cuts.q[n.i], 8) AS value FROM cuts CROSS JOIN
           (VALUES ('5%', CAST(0.05 AS DOUBLE), 1), ('40%', CAST(0.4 AS DOUBLE), 2),
                   ('60%', CAST(0.6 AS DOUBLE), 3), ('95%', CAST(0.95 AS DOUBLE), 4)) n(quantile, probability, i)""",
        "cuts",
    ),
    "grouped_quantiles": sql(
        """SELECT scenario, count(gpp) AS n, round(quantile_cont(gpp, 0.25), 8) AS q0,
                  round(quantile_cont(gpp, 0.5), 8) AS q1, round(quantile_cont(gpp, 0.9), 8) AS q2
           FROM obs GROUP BY scenario""",
        "obs",
    ),
    "classified": sql(f"SELECT Year, Source, {r('Precip')}, Condition FROM cls", "cls"),
    "class_summary": sql(f"SELECT Condition, {r('min mean max')} FROM csum", "csum"),
    "class_distance": sql(
        f"SELECT Year, Condition, {r('reference Min_Dif Mean_Dif Max_Dif')} FROM dist", "dist"
    ),
    "class_targets": sql(f"SELECT Class, Condition, Metric, {r('Precip')} FROM targets", "targets"),
    "ecdf_rank": sql(
        """SELECT Year, Source, round(Precip, 8) AS Precip,
                  round((SELECT count(*) FROM stations s WHERE s.Precip <= q.Precip)
                        / (SELECT count(*) FROM stations), 8) AS Quantile
           FROM series q WHERE Source = 'purchase'""",
        "series",
        "stations",
    ),
    "year_report": sql(
        """SELECT Class, Year, round(reference, 8) AS GLDAS, round(t.Precip, 8) AS Stations, Metric,
                  round((SELECT count(*) FROM stations s WHERE s.Precip <= reference)
                        / (SELECT count(*) FROM stations), 8) AS Quantile
           FROM dist JOIN chosen USING (Year) JOIN targets t USING (Class)""",
        "dist",
        "chosen",
        "targets",
        "stations",
    ),
    "year_classes": sql(
        """SELECT Class, Year, round(Precip, 8) AS Precip
           FROM chosen LEFT JOIN (SELECT Year, Precip FROM cls WHERE Source = 'purchase') USING (Year)""",
        "chosen",
        "cls",
    ),
    "subperiods": sql(f"SELECT Source, Year, Month, {r('Precip')}, Condition FROM parts", "parts"),
    "highlight": sql(
        """SELECT Year, Source, Month, round(Precip, 8) AS Precip, Condition, Class
           FROM parts JOIN chosen USING (Year)
           WHERE Source = 'purchase' AND Precip IS NOT NULL AND Condition IS NOT NULL""",
        "parts",
        "chosen",
    ),
    "station_years": sql(
        """SELECT s.Year, s.Source, round(s.Precip, 8) AS Precip_01, s.Condition, k.Class,
                  round(k.Precip, 8) AS Precip_02
           FROM (SELECT * FROM cls WHERE Source IN ('view', 'click') AND Precip IS NOT NULL
                   AND Condition IS NOT NULL) s
           LEFT JOIN (SELECT Class, Year, Precip FROM chosen LEFT JOIN
                        (SELECT Year, Precip FROM cls WHERE Source = 'purchase') USING (Year)) k USING (Year)""",
        "cls",
        "chosen",
    ),
    "metrics_enriched": sql(f"SELECT {_found}, {_dims} FROM found_enr", "found_enr"),
    "metrics_carried": sql(f"SELECT {_found}, {_dims} FROM found_enr", "found_enr"),
    "cohort": sql(
        f"SELECT {_found}, {_dims}, CAST(recovery_order AS INTEGER) AS recovery_order FROM coh", "coh"
    ),
    "metrics_wide": sql(f"SELECT id, scenario, veg_type, {r(' '.join(WIDE))} FROM wide", "wide"),
    "summary_stats": sql(
        f"SELECT variable, n, {r('min mean median max sd')} FROM ({_summary})", "wide_long"
    ),
    "summary_transposed": sql(
        f""", s AS ({_summary}), l AS ("""
        + " UNION ALL ".join(
            f"SELECT variable, '{s}' AS metric, CAST({s} AS DOUBLE) AS value FROM s"
            for s in ("n", "min", "mean", "median", "max", "sd")
        )
        + ") SELECT metric, "
        + ", ".join(f"round(max(CASE WHEN variable = '{c}' THEN value END), 8) AS {c}" for c in WIDE)
        + " FROM l GROUP BY metric",
        "wide_long",
    ),
    "boxplot_metric": sql(
        f""", b AS (SELECT l.* FROM wide_long l JOIN (SELECT id, scenario FROM wide WHERE {_complete})
                   USING (id, scenario) WHERE variable NOT IN ('gpp_recovery', 'precip_recovery'))"""
        + _box("b", "variable, veg_type", "value"),
        "wide_long",
    ),
    "boxplot_subperiod": sql(
        """, b AS (SELECT * FROM parts WHERE Source IN ('view', 'click') AND Precip IS NOT NULL
                     AND Condition IS NOT NULL)"""
        + _box("b", "Month, Condition", "Precip"),
        "parts",
    ),
    "boxplot_outliers": """SELECT event_type, round(value, 8) AS value FROM events JOIN
             (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
              FROM events GROUP BY event_type) USING (event_type)
           WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "hexbin": sql(
        """, h AS (SELECT gpp_impact AS px, gpp_recovery_base AS py FROM wide
                   WHERE gpp_impact IS NOT NULL AND gpp_recovery_base IS NOT NULL)"""
        + _hex("h", "", "x1 - x0", "y1 - y0"),
        "wide",
    ),
    "hexbin_limits": sql(
        """, h AS (SELECT scenario, precip AS px, gpp AS py FROM obs
                   WHERE precip BETWEEN 5 AND 45 AND gpp BETWEEN 0 AND 80)"""
        + _hex("h", "scenario", "CAST(40 AS DOUBLE)", "CAST(80 AS DOUBLE)"),
        "obs",
    ),
    "histogram": sql(
        """, h AS (SELECT Precip AS v FROM cls WHERE Source IN ('view', 'click') AND Precip IS NOT NULL
                     AND Condition IS NOT NULL)"""
        + _hist("h", "", 7, 8),
        "cls",
    ),
    "histogram_residuals": sql(
        ", h AS (SELECT formula, resid AS v FROM resids WHERE resid IS NOT NULL)"
        + _hist("h", "formula", 30, 6),
        "resids",
    ),
    "coef_density": sql(_density("clong", "metric, term, veg_type", "metric, term", "estimate"), "clong"),
    "ratio_density": sql(_density("rmed", "metric, veg_type", "metric", "median"), "rmed"),
    "smooth_line": sql(
        """, h AS (SELECT formula, veg_type, x AS px, fitted AS py FROM resids
                   WHERE x BETWEEN 0 AND 1 AND fitted IS NOT NULL)"""
        + _line("h", "formula, veg_type"),
        "resids",
    ),
    "smooth_line_raw": sql(
        ", h AS (SELECT scenario, precip AS px, gpp AS py FROM obs WHERE gpp BETWEEN 0 AND 80)"
        + _line("h", "scenario"),
        "obs",
    ),
    "resample": sql("SELECT sample_id, veg_type, id, scenario FROM sampled", "sampled"),
    "resample_panel": sql(
        f""", {_resample('panel', 'scenario', 'y, x, year', 25, 8)}
        SELECT scenario, x, y, year, round(precip, 8) AS precip, round(gpp, 8) AS gpp, sample_id
        FROM numbered JOIN taken USING (scenario, pos)""",
        "panel",
    ),
    "sample_rows": sql(
        f"""SELECT scenario, x, y, year, round(precip, 8) AS precip, round(gpp, 8) AS gpp FROM (
              SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY
                       {_random('2021', 'scenario', 'x', 'y', 'year')}, x, y, year) AS r FROM panel)
            WHERE r <= 30""",
        "panel",
    ),
    "residual_sample": sql(
        f"""SELECT formula, sample_id, veg_type, id, scenario, {r('y x fitted resid', 6)} FROM (
              SELECT *, row_number() OVER (PARTITION BY formula, veg_type ORDER BY
                       {_random('2021', 'formula', 'sample_id', 'id', 'scenario')},
                       formula, sample_id, id, scenario) AS r FROM resids) WHERE r <= 30""",
        "resids",
    ),
    "pair_rows": sql(
        f"SELECT id, scenario, sample_id, veg_type, formula, {r('y x')} FROM pairs", "pairs"
    ),
    "ols_coefs": sql(
        f"SELECT formula, sample_id, veg_type, {r('intercept slope', 6)}, n FROM coefs", "coefs"
    ),
    "ols_pairs": sql(
        f"SELECT formula, sample_id, veg_type, {r('intercept slope', 6)}, n FROM coefs", "coefs"
    ),
    "ols_scenarios": sql(
        """SELECT scenario, round(regr_intercept(gpp, precip), 6) AS intercept,
                  round(regr_slope(gpp, precip), 6) AS slope, CAST(regr_count(gpp, precip) AS BIGINT) AS n,
                  round(regr_r2(gpp, precip), 6) AS r2 FROM obs GROUP BY scenario""",
        "obs",
    ),
    "residuals": sql(
        f"SELECT formula, sample_id, veg_type, id, scenario, {r('y x fitted resid', 6)} FROM resids", "resids"
    ),
    "mae": sql(
        "SELECT formula, veg_type, round(avg(abs(resid)), 6) AS mae FROM resids GROUP BY ALL", "resids"
    ),
    "coef_long": sql(f"SELECT sample_id, veg_type, metric, term, {r('estimate', 6)} FROM clong", "clong"),
    "confidence_band": sql(
        """, g AS (SELECT formula, veg_type, min(x) AS lo, max(x) AS hi FROM cpairs GROUP BY ALL),
             p AS (SELECT formula, veg_type, CAST(point AS INTEGER) AS point,
                          lo + (hi - lo) * point / 99 AS x,
                          intercept + slope * (lo + (hi - lo) * point / 99) AS fitted
                   FROM coefs JOIN g USING (formula, veg_type) CROSS JOIN generate_series(0, 99) t(point)),
             q AS (SELECT formula, veg_type, point, max(x) AS x,
                          quantile_cont(fitted, CAST(0.025 AS DOUBLE)) AS low,
                          quantile_cont(fitted, CAST(0.975 AS DOUBLE)) AS high FROM p GROUP BY ALL)
        SELECT formula, veg_type, point, round(x, 6) AS x,
               round(CASE WHEN low < 0 THEN 0 ELSE low END, 6) AS low,
               round(CASE WHEN high < 0 THEN 0 ELSE high END, 6) AS high FROM q""",
        "cpairs",
        "coefs",
    ),
    "ratio_median": sql(f"SELECT sample_id, veg_type, {r('median')}, metric FROM rmed", "rmed"),
}

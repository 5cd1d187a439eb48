"""The queries' SQL for DuckDB."""

from __future__ import annotations

from partmill.plans import tables as T

DASH = r"\x{2010}-\x{2015}"
CAT = f"cat_rows AS ({T.CAT_ROWS})"


def sized(c: str, cut: str = "true") -> str:
    return f"CASE WHEN length({c}) = 10 THEN {c} || '00' WHEN length({c}) > 12 AND {cut} THEN substr({c}, 1, 12) ELSE {c} END"


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


X1 = sized(rf"regexp_replace(part_no, '[\s\-.{DASH}]', '', 'g')")
_X2 = rf"regexp_replace(replace(regexp_replace(part_no, '[{DASH}]', '-', 'g'), '.', ''), '^[ ,.;:\-_]+|[ ,.;:\-_]+$', '', 'g')"
X2 = sized(_X2, f"{_X2} NOT LIKE '%-%'")
X3 = squeeze(rf"regexp_replace(description, '[.\-_,{DASH}]', ' ', 'g')")
_X4 = r"regexp_replace(regexp_replace(regexp_replace(remarks, '\b(UR|AB|YB)\b', '', 'gi'), '\(\s*\)', '', 'g'), '[,/\\|\-–—]\s*[,/\\|\-–—]+', ' ', 'g')"
_X4 = squeeze(rf"regexp_replace({_X4}, '^[\s,/\-–—.:;]+|[\s,/\-–—.:;]+$', '', 'g')")
X4 = f"CASE WHEN regexp_matches({_X4}, '[A-Za-z0-9]') THEN {_X4} ELSE '' END"
P = f"WITH {CAT}, p AS (SELECT doc_id, row_seq, page, fig_no, fig_name, ref_no, {X1} AS part_no, {X3} AS description, {X4} AS remarks, qty1, qty2 FROM cat_rows)"
PM = f"{P}, m AS (SELECT *, 'BGP1' AS model, qty1 AS q FROM p UNION ALL SELECT *, 'BGP2', qty2 FROM p)"


def valid(c: str) -> str:
    return f"lower(trim({c})) NOT IN ('', '-', 'none', 'null', '0', '*')"


KEY = "doc_id, trim(fig_no), trim(fig_name)"
# Runs: rows of one figure key in a row.
RUNS = f"{P}, s AS (SELECT *, coalesce(lag((fig_no, fig_name)) OVER d <> (fig_no, fig_name), true) AS starts, max(CASE WHEN remarks <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY}) AS has, row_number() OVER (PARTITION BY doc_id, fig_no, fig_name ORDER BY row_seq) = 1 AS is_parent FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY row_seq)), r AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY row_seq) AS run, sum((starts OR is_parent)::INT) OVER (PARTITION BY doc_id ORDER BY row_seq) AS block FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY row_seq) - 1 AS run_offset, count(*) OVER (PARTITION BY doc_id, block, ref_no) AS same, row_number() OVER (PARTITION BY doc_id, block, ref_no ORDER BY row_seq) AS nth FROM r)"
SUFFIXED = "CASE WHEN same > 1 THEN ref_no || chr(CAST(64 + nth AS INT)) ELSE ref_no END"
LOOSE = "('', '0', '-')"
VALID_ROWS = f"""{P}, v AS (SELECT doc_id, row_seq, upper(trim(ref_no)) <> '' AND count(*) OVER (PARTITION BY {KEY}, upper(trim(ref_no))) > 1 AS duplicate_ref,
 trim(part_no) = '' AS no_part_no, trim(part_no) <> '' AND length(part_no) < 5 AS short_part_no, trim(description) = '' AS no_description, trim(qty1) IN {LOOSE} AND trim(qty2) IN {LOOSE} AS no_quantity FROM p)"""
IMAGES = f"WITH doc_images AS ({T.DOC_IMAGES}), page_figures AS ({T.PAGE_FIGURES.replace('page / 2', 'page // 2')}), i AS (SELECT * FROM doc_images LEFT JOIN page_figures USING (doc_id, page))"
BIKE = r"regexp_matches(filename, '(?i)\bbike\b|_bike')"
JOBS = f"WITH job_events AS ({T.JOB_EVENTS})"
# A cart's quantity is its running sum reflected at 0.
CART = f"""WITH e AS ({T.CART_EVENTS}), a AS (SELECT *, sum(delta) OVER w AS s FROM e WINDOW w AS (PARTITION BY cart_id, part_no ORDER BY seq)),
 b AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY cart_id, part_no ORDER BY seq)) AS n FROM a),
 c AS (SELECT cart_id, part_no, arg_max(n, seq) AS qty, coalesce(max(CASE WHEN n <= 0 THEN seq END), -1) AS z FROM b GROUP BY 1, 2),
 firsts AS (SELECT b.cart_id, b.part_no, any_value(qty) AS qty, arg_min({{'d': description, 'm': mrp, 'p': dealer_price, 'g': gst_rate, 'r': ref_no, 'n': fig_no, 'f': fig_name}}, seq) AS x FROM b JOIN c ON b.cart_id = c.cart_id AND b.part_no = c.part_no AND seq > z WHERE qty > 0 GROUP BY 1, 2),
 lines AS (SELECT cart_id, part_no, qty, CASE WHEN x.d = '' THEN 'GENUINE SPARE PART' ELSE x.d END AS description, x.r AS ref_no, x.n AS fig_no, x.f AS fig_name, coalesce(nullif(x.m, 0), nullif(x.p, 0), 120)::DOUBLE AS price, coalesce(nullif(x.g, 0), 28)::DOUBLE AS gst FROM firsts)"""

PIXELS = f"""WITH a AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM ({T.PIXELS})),
 b AS (SELECT *, hi / 255::DOUBLE AS v, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi::DOUBLE END AS s, (hi - lo)::DOUBLE AS d, lo < 242 AS s242, lo < 240 AS s240 FROM a),
 c AS (SELECT *, floor(s * 255) >= 18 AS colored, s >= 0.18::DOUBLE AND v >= 0.15::DOUBLE AS vivid, 60 * CASE WHEN d = 0 THEN 0 WHEN r = hi THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN g = hi THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS h FROM b),
 s AS (SELECT image_id, count(*) AS n, count(DISTINCT (r, g, b)) AS n_colors, round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 6) AS spread, round(avg(h) FILTER (s240 AND vivid), 6) AS mean_hue, count_if(colored) / count(*) AS colored,
  count_if(s242) AS n242, count_if(s240) AS n240, count_if(s242 AND vivid) AS v242, count_if(s240 AND vivid) AS v240, count_if(s242 AND v <= 0.45::DOUBLE) AS nd, count_if(lo >= 248) / count(*) AS white, count_if(hi <= 15) / count(*) AS black FROM c GROUP BY 1)
SELECT image_id, n, n_colors, spread, mean_hue, colored >= 0.025 AS is_colored, CASE WHEN n242 > 0 THEN v242 / n242 < 0.05 AND nd / n242 >= 0.35 ELSE false END AS is_black,
 CASE WHEN n240 = 0 OR v240 / n240 < 0.02 THEN '' WHEN mean_hue < 15 OR mean_hue >= 345 THEN 'RED' WHEN mean_hue < 45 THEN 'ORANGE' WHEN mean_hue < 75 THEN 'YELLOW' WHEN mean_hue < 165 THEN 'GREEN' WHEN mean_hue < 205 THEN 'CYAN' WHEN mean_hue < 265 THEN 'BLUE' ELSE 'PURPLE' END AS hue,
 n_colors >= 70 AND spread >= 18 AND white <= 0.88 AND NOT (black > 0.5 AND white > 0.25) AS is_photo FROM s"""

# Thumbnails in SQL: variants 0 (laid over white) and 1 (alpha dropped) of 120 pixels, 2 of 150; box means, then weights per axis, columns before rows.
_TONES = {n: v.format(x="x", y="y") for n, v in T.TONES.items()}
_AXIS = """SELECT image_id, v, o, i, (CASE WHEN w < 0 THEN -1 ELSE 1 END * floor(abs(w) * 4194304 + 0.5))::BIGINT AS w FROM (SELECT image_id, v, o, i, u / sum(u) OVER (PARTITION BY image_id, v, o) AS w FROM (
 SELECT image_id, v, o, i, CASE WHEN t < 1 THEN (1.5::DOUBLE * t - 2.5) * t * t + 1 WHEN t < 2 THEN (((t - 5) * t + 8) * t - 4) * -0.5::DOUBLE ELSE 0 END AS u FROM (
 SELECT image_id, v, o, i, n, c, z, abs((i - c + 0.5::DOUBLE) / z) AS t FROM (SELECT image_id, v, o, unnest(range(n)) AS i, n, (o + 0.5::DOUBLE) * e / q AS c, greatest(e / q, 1::DOUBLE) AS z FROM (SELECT image_id, v, {out} AS q, {full} / {box}::DOUBLE AS e, ({full} + {box} - 1) // {box} AS n, unnest(range({out})) AS o FROM fit)))
 WHERE i >= trunc(greatest(c - 2 * z + 0.5::DOUBLE, 0)) AND i < trunc(least(c + 2 * z + 0.5::DOUBLE, n))))"""
_PASS = "least(greatest((sum({c}::BIGINT * w) + 2097152) >> 22, 0), 255) AS {c}"
RASTERS = f"""WITH im AS ({T.RASTER_SIZES}),
px AS (SELECT * REPLACE (CASE WHEN mode = '1' THEN CASE WHEN r > 127 THEN 255 ELSE 0 END ELSE r END AS r) FROM (SELECT *, {_TONES['r']} AS r, {_TONES['g']} AS g, {_TONES['b']} AS b, CASE WHEN mode IN ('LA', 'RGBA') THEN {_TONES['a']} ELSE 255 END AS a
  FROM (SELECT *, p % width AS x, p // width AS y FROM (SELECT *, unnest(range((width * height)::BIGINT)) AS p FROM im)))),
rgb AS (SELECT image_id, x, y, a, r, CASE WHEN mode LIKE 'RGB%' THEN g ELSE r END AS g, CASE WHEN mode LIKE 'RGB%' THEN b ELSE r END AS b FROM px),
vs AS (SELECT image_id, 0 AS v, x, y, round_even((r * a + 255 * (255 - a)) / 255::DOUBLE, 0)::INT AS r, round_even((g * a + 255 * (255 - a)) / 255::DOUBLE, 0)::INT AS g, round_even((b * a + 255 * (255 - a)) / 255::DOUBLE, 0)::INT AS b FROM rgb
 UNION ALL SELECT image_id, t.v, x, y, r, g, b FROM rgb CROSS JOIN (VALUES (1), (2)) t(v)),
side AS (SELECT *, width / height::DOUBLE AS f FROM im CROSS JOIN (VALUES (0, 120), (1, 120), (2, 150)) t(v, q)),
fit0 AS (SELECT *, CASE WHEN width <= q AND height <= q THEN width WHEN f > 1 THEN q ELSE greatest(CASE WHEN abs(f - floor(q * f) / q) <= abs(f - ceil(q * f) / q) THEN floor(q * f) ELSE ceil(q * f) END, 1) END::BIGINT AS ow,
 CASE WHEN width <= q AND height <= q THEN height WHEN f <= 1 THEN q ELSE greatest(CASE WHEN floor(q / f) = 0 OR abs(f - q / floor(q / f)) <= abs(f - q / ceil(q / f)) THEN floor(q / f) ELSE ceil(q / f) END, 1) END::BIGINT AS oh FROM side),
fit AS (SELECT *, greatest(floor(width / ow::DOUBLE / 2), 1)::BIGINT AS fx, greatest(floor(height / oh::DOUBLE / 2), 1)::BIGINT AS fy FROM fit0),
bx AS (SELECT image_id, v, x // fx AS x, y // fy AS y, (sum(r) + count(*) // 2) // count(*) AS r, (sum(g) + count(*) // 2) // count(*) AS g, (sum(b) + count(*) // 2) // count(*) AS b FROM vs JOIN fit USING (image_id, v) GROUP BY ALL),
wx AS ({_AXIS.format(out="ow", full="width", box="fx")}), wy AS ({_AXIS.format(out="oh", full="height", box="fy")}),
across AS (SELECT bx.image_id, bx.v, o AS x, y, {", ".join(_PASS.format(c=c) for c in "rgb")} FROM bx JOIN wx ON bx.image_id = wx.image_id AND bx.v = wx.v AND bx.x = wx.i GROUP BY ALL),
th AS (SELECT across.image_id, across.v, x, o AS y, {", ".join(_PASS.format(c=c) for c in "rgb")} FROM across JOIN wy ON across.image_id = wy.image_id AND across.v = wy.v AND across.y = wy.i GROUP BY ALL),
a AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM th),
b AS (SELECT *, hi / 255::DOUBLE AS val, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi::DOUBLE END AS s, (hi - lo)::DOUBLE AS d FROM a),
c AS (SELECT *, s >= 0.18::DOUBLE AND val >= 0.15::DOUBLE AS vivid, 60 * CASE WHEN d = 0 THEN 0 WHEN r = hi THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN g = hi THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS h FROM b),
laid AS (SELECT image_id, count(DISTINCT (r, g, b)) AS n_colors, round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 6) AS spread, count_if(lo >= 248) / count(*) AS white, count_if(hi <= 15) / count(*) AS black FROM c WHERE v = 0 GROUP BY 1),
plain AS (SELECT image_id, count(*) AS n, count_if(lo < 242) AS n242, count_if(lo < 240) AS n240, count_if(lo < 242 AND vivid) AS v242, count_if(lo < 240 AND vivid) AS v240, count_if(lo < 242 AND val <= 0.45::DOUBLE) AS nd, round(avg(h) FILTER (lo < 240 AND vivid), 6) AS mean_hue FROM c WHERE v = 1 GROUP BY 1),
tint AS (SELECT image_id, count_if(hi > 0 AND floor(((hi - lo)::FLOAT / hi::FLOAT)::DOUBLE * 255) >= 18) / count(*) AS colored FROM c WHERE v = 2 GROUP BY 1)
SELECT image_id, n, n_colors, spread, mean_hue, colored >= 0.025 AS is_colored, mode <> '1' AND CASE WHEN n242 > 0 THEN v242 / n242 < 0.05 AND nd / n242 >= 0.35 ELSE false END AS is_black,
 CASE WHEN n240 = 0 OR v240 / n240 < 0.02 THEN '' WHEN mean_hue < 15 OR mean_hue >= 345 THEN 'RED' WHEN mean_hue < 45 THEN 'ORANGE' WHEN mean_hue < 75 THEN 'YELLOW' WHEN mean_hue < 165 THEN 'GREEN' WHEN mean_hue < 205 THEN 'CYAN' WHEN mean_hue < 265 THEN 'BLUE' ELSE 'PURPLE' END AS hue,
 mode <> '1' AND width >= 120 AND height >= 80 AND f BETWEEN 0.65 AND 3.0 AND n_colors >= 70 AND spread >= 18 AND white <= 0.88 AND NOT (black > 0.5 AND white > 0.25) AS is_photo
FROM laid JOIN plain USING (image_id) JOIN tint USING (image_id) JOIN (SELECT image_id, mode, width, height, f FROM side WHERE v = 0) USING (image_id)"""

# Pages of both formats: figures, runs, carried references, names, suffixes and flags, from the rows that the pages show.
LIFECYCLE = rf"""WITH {CAT}, pg AS (SELECT DISTINCT doc_id, page, fig_no AS no, fig_name AS name, page % 10 AS k FROM cat_rows WHERE page % 10 <> 5),
s AS (SELECT *, k IN (2, 7) AS b, k NOT IN (2, 4, 7) AS a, min(CASE WHEN k <> 4 THEN page END) OVER (PARTITION BY doc_id) AS start FROM pg),
l AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS fig_name, last_value(said IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM (SELECT *, CASE WHEN a OR k = 2 THEN name WHEN b AND page = start THEN 'FIG 1' END AS said FROM s WHERE page >= start)),
g AS (SELECT *, b AND (page = start OR (k = 2 AND name <> coalesce(prior, ''))) AS grows FROM l),
n AS (SELECT *, CASE WHEN a THEN no WHEN grows THEN (sum(grows::INT) OVER (PARTITION BY doc_id ORDER BY page))::VARCHAR END AS number FROM g),
f AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS fig_no, last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n),
r AS (SELECT *, sum(CASE WHEN b THEN grows WHEN a THEN number <> coalesce(before, '') ELSE false END::INT) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM f),
e AS (SELECT c.doc_id, c.page, r.fig_no, r.fig_name, run, b, c.row_seq AS nr, CASE WHEN c.row_seq % 4 <> 0 THEN ref_no END AS ref, {X2} AS part_no, {X3} AS description, {X4} AS remarks, qty1, CASE WHEN b THEN '' ELSE qty2 END AS qty2,
  CASE c.doc_id % 3 WHEN 0 THEN 'BGP1' WHEN 1 THEN 'PGB1' ELSE CASE WHEN b THEN 'MODEL' ELSE 'BGP1' END END AS model, CASE c.doc_id % 3 WHEN 0 THEN 'R15 V4' WHEN 1 THEN 'PGB1' ELSE '' END AS title FROM cat_rows c JOIN r USING (doc_id, page) WHERE k <> 9),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS row_seq, coalesce(last_value(ref IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY nr), '') AS ref_no, row_number() OVER (PARTITION BY doc_id, fig_no, fig_name ORDER BY nr) = 1 AS is_parent,
  coalesce(lag((fig_no, fig_name)) OVER (PARTITION BY doc_id ORDER BY nr) <> (fig_no, fig_name), true) AS starts, max((remarks <> '')::INT) OVER (PARTITION BY doc_id, fig_no, fig_name) = 1 AS has FROM e),
o AS (SELECT *, sum((starts OR is_parent)::INT) OVER (PARTITION BY doc_id ORDER BY nr) AS block FROM p),
q AS (SELECT *, count(*) OVER (PARTITION BY doc_id, block, ref_no) AS same, row_number() OVER (PARTITION BY doc_id, block, ref_no ORDER BY nr) AS nth FROM o),
v AS (SELECT *, 'YAM_' || model || '_' || upper({squeeze("regexp_replace(fig_name, '[^A-Za-z0-9&]+', ' ', 'g')")}) AS code, 'YAMAHA ' || model || CASE WHEN title = '' THEN ' ' ELSE ' ' || title || ' ' END || 'Series ' || upper({squeeze('fig_name')}) AS named FROM q),
m AS (SELECT doc_id, min(CASE WHEN k NOT IN (2, 7, 9) THEN page END) AS a, min(CASE WHEN b THEN page END) AS b FROM r GROUP BY 1),
d AS (SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CASE WHEN a IS NULL THEN c ELSE c || ',BGP2' END WHEN a IS NULL THEN 'MODEL' WHEN b IS NULL THEN 'BGP1,BGP2' WHEN a < b THEN 'BGP1,BGP2,MODEL' ELSE 'MODEL,BGP1,BGP2' END AS models FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'BGP1' ELSE 'PGB1' END AS c FROM m)),
x AS (SELECT doc_id, max(row_seq) AS last, any_value(models) AS models, split_part(any_value(models), ',', 1) AS model, any_value(title) AS title FROM v JOIN d USING (doc_id) GROUP BY 1),
y AS (SELECT *, CASE WHEN k < 10 THEN 'PART KITS & SETS' ELSE 'REGULAR SERVICE PARTS' END AS section, k IN (0, 10) AS is_parent FROM x CROSS JOIN (SELECT unnest(range(0, 25)) AS k))
SELECT doc_id, row_seq, page, fig_no, fig_name, CASE WHEN ref_no <> '' AND same > 1 THEN ref_no || chr((64 + nth)::INT) ELSE ref_no END AS ref_no, part_no, description, remarks, CASE WHEN starts AND has THEN 'X' ELSE '' END AS remark_flag, is_parent, false AS is_custom_section, model AS model_code,
 CASE WHEN is_parent THEN model ELSE '' END AS item_group, CASE WHEN is_parent THEN code ELSE '' END AS catalogue_code, CASE WHEN is_parent THEN named ELSE '' END AS model_name, CASE WHEN is_parent THEN code || '.jpeg' ELSE '' END AS pic_path, models, qty1 AS q1, qty2 AS q2 FROM v JOIN d USING (doc_id)
UNION ALL SELECT doc_id, last + 1 + k, NULL, '', CASE WHEN is_parent THEN section ELSE '' END, '', '', '', '', '', is_parent, true, model, CASE WHEN is_parent THEN model ELSE '' END, CASE WHEN is_parent THEN 'YAM_' || model || '_' || section ELSE '' END,
 CASE WHEN is_parent THEN 'YAMAHA ' || model || CASE WHEN title = '' THEN ' ' ELSE ' ' || title || ' ' END || 'Series ' || section ELSE '' END, CASE WHEN is_parent THEN 'YAM_' || model || '_' || section || '.jpeg' ELSE '' END, models, '', '' FROM y"""

ORACLE_SQL = {
    "x18_w5_lifecycle": LIFECYCLE,
    "flagship_part_counts": f"{RUNS}, f AS (SELECT *, {SUFFIXED} AS ref2, CASE WHEN starts AND has = 1 THEN 'X' ELSE '' END AS flag FROM o), m AS (SELECT *, 'BGP1' AS model, qty1 AS q FROM f UNION ALL SELECT *, 'BGP2', qty2 FROM f) SELECT doc_id, model, count(*) AS parts, count_if(regexp_matches(ref2, '[A-Z]$'))::BIGINT AS suffixed, count_if(flag = 'X')::BIGINT AS flagged, count_if(is_parent)::BIGINT AS parents FROM m WHERE {valid('q')} GROUP BY 1, 2",
    "x1_x4_texts": f"WITH {CAT} SELECT doc_id, row_seq, {X1} AS x1, {X2} AS x2, {X3} AS x3, {X4} AS x4 FROM cat_rows",
    "x5_x6_x7_x10_x27_codes": rf"WITH {CAT}, c AS (SELECT *, (row_seq % 800)::INT AS i, upper(trim(regexp_replace(fig_name, '[^A-Za-z0-9&]+', ' ', 'g'))) AS n FROM cat_rows) SELECT doc_id, row_seq, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(64 + i // 26) || chr(65 + i % 26) ELSE chr(65 + (i - 702) // 676) || chr(65 + (i - 702) // 26 % 26) || chr(65 + i % 26) END AS x5, 'YAM_BGP1_' || n AS x6, 'YAM_BGP1_' || n || '.jpeg' AS x7, 'YAM_B$1_' || n AS x10, trim(replace(fig_name, ' ', '_'), '_') AS x27 FROM c",
    "x8_x9_x11_x12_model_names": f"WITH {CAT} SELECT doc_id, row_seq, 'YAMAHA' AS x9, description AS x11, 'YAMAHA BGP2 ' || description || ' Series ' || upper(fig_name) AS x12, 'YAMAHA BGP1 ' || CASE WHEN remarks = '' THEN '' ELSE remarks || ' ' END || 'Series ' || upper(fig_name) AS x8 FROM cat_rows",
    "x28_money": "SELECT p_partkey, round(p_retailprice, 2)::DOUBLE AS price, (p_size % 30)::DOUBLE AS rate, NULL::DOUBLE AS bad FROM part",
    "x29_fit": f"{IMAGES}, s AS (SELECT *, least(1000 / width, 1200 / height) AS k, least(1.0::DOUBLE, 300 / greatest(width, height)) AS e FROM doc_images), t AS (SELECT *, greatest(1, round_even(width * k, 0)::INT) AS w, greatest(1, round_even(height * k, 0)::INT) AS h FROM s) SELECT image_id, w AS width, h AS height, ((1000 - w) // 2)::INT AS \"left\", ((1200 - h) // 2)::INT AS top, greatest(1, floor(width * 0.5::DOUBLE + 0.5)::INT) AS pw, greatest(1, floor(height * 0.5::DOUBLE + 0.5)::INT) AS ph, greatest(1, floor(width * e + 0.5)::INT) AS ew, greatest(1, floor(height * e + 0.5)::INT) AS eh FROM t",
    "w6_first_of_figure": f"{RUNS} SELECT doc_id, row_seq, is_parent FROM o",
    "w7_suffix_refs": f"{RUNS} SELECT doc_id, row_seq, {SUFFIXED} AS ref_no FROM o",
    "w8_figure_offset": f"{RUNS} SELECT doc_id, row_seq, starts AS first_in_run, run_offset::INT AS run_offset FROM o",
    "w9_j15_remark_flags": f"{RUNS} SELECT doc_id, row_seq, CASE WHEN starts AND has = 1 THEN 'X' ELSE '' END AS remark_flag FROM o",
    "w10_blank_children": f"{RUNS} SELECT doc_id, row_seq, CASE WHEN starts THEN page::VARCHAR ELSE '' END AS page, CASE WHEN starts THEN fig_no ELSE '' END AS fig_no, CASE WHEN starts THEN fig_name ELSE '' END AS fig_name FROM o",
    "f9_f10_f11_for_model": f"{P} SELECT doc_id, row_seq, trim(qty1) AS q1 FROM p WHERE {valid('qty1')}",
    "f12_any_model": f"{P} SELECT doc_id, row_seq, qty1 AS q1, qty2 AS q2 FROM p WHERE {valid('qty1')} OR {valid('qty2')}",
    "a1_part_counts": f"{PM} SELECT doc_id, model, count_if({valid('q')})::BIGINT AS parts FROM m GROUP BY 1, 2",
    "f13_dashboard_search": f"{P} SELECT doc_id, row_seq FROM p WHERE {valid('qty1')} AND (lower(part_no) LIKE '%ring%' OR lower(description) LIKE '%ring%' OR lower(remarks) LIKE '%ring%' OR lower(fig_name) LIKE '%ring%' OR ref_no LIKE '%ring%')",
    "f14_table_search": f"{P} SELECT doc_id, row_seq FROM p WHERE part_no LIKE '%896%' OR description LIKE '%896%' OR remarks LIKE '%896%' OR fig_name LIKE '%896%' OR fig_no LIKE '%896%' OR ref_no LIKE '%896%'",
    "a5_a6_validation": f"{VALID_ROWS} SELECT *, duplicate_ref OR no_part_no OR short_part_no OR no_description OR no_quantity AS has_issue, concat_ws(',', CASE WHEN duplicate_ref THEN 'duplicate_ref' END, CASE WHEN no_part_no THEN 'no_part_no' END, CASE WHEN short_part_no THEN 'short_part_no' END, CASE WHEN no_description THEN 'no_description' END, CASE WHEN no_quantity THEN 'no_quantity' END) AS issues FROM v",
    "f15_issue_rows": f"{VALID_ROWS} SELECT doc_id, row_seq FROM v WHERE duplicate_ref",
    "a7_quality_summary": f"{VALID_ROWS}, b AS (SELECT *, duplicate_ref OR no_part_no OR short_part_no OR no_description OR no_quantity AS bad FROM v) SELECT count(*) AS n_rows, count_if(bad)::BIGINT AS n_issues, count_if(duplicate_ref)::BIGINT AS n_duplicate_ref, count_if(no_part_no OR short_part_no)::BIGINT AS n_part_no, count_if(no_description)::BIGINT AS n_description, count_if(no_quantity)::BIGINT AS n_quantity, floor((count(*) - count_if(bad)) / count(*) * 100 + 0.5)::INT AS clean_rate FROM b",
    "o1_flag_rank": f"{P}, f AS (SELECT *, CASE WHEN row_seq % 13 = 0 THEN 'x' WHEN row_seq % 17 = 0 THEN 'note' ELSE '' END AS flag, max((remarks <> '')::INT) OVER (PARTITION BY {KEY}) = 1 OR row_seq % 13 = 0 AS x FROM p) SELECT doc_id, row_seq, row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, flag DESC, row_seq) AS rank FROM f",
    "o1_sort_rank": f"{P} SELECT doc_id, row_seq, row_number() OVER (PARTITION BY doc_id ORDER BY fig_no::DOUBLE DESC, row_seq)::INT AS rank FROM p",
    "o2_deep_page": f"{P} SELECT doc_id, row_seq, description FROM p ORDER BY lower(description) DESC, doc_id, row_seq LIMIT 50 OFFSET 4950",
    "o2_page": f"{P} SELECT doc_id, row_seq, part_no FROM p ORDER BY lower(part_no), doc_id, row_seq LIMIT 50 OFFSET 50",
    "o3_heads": f"{P} SELECT doc_id, row_seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_seq) AS k FROM p) WHERE k <= 2",
    "f20_row_edits": f"{P}, l AS (SELECT doc_id, max(row_seq) AS last, arg_max(fig_no, row_seq) AS fig_no, arg_max(page, row_seq) AS page FROM p GROUP BY 1) SELECT doc_id, row_seq, CASE WHEN row_seq % 11 = 0 THEN '1AB2C345' ELSE part_no END AS part_no, fig_no, page, qty1 AS q1, qty2 AS q2 FROM p WHERE row_seq % 7 <> 0 UNION ALL SELECT doc_id, last + 1, 'NEW-PART-00', fig_no, page, '1', '1' FROM l",
    "j8_model_name_edits": f"{RUNS} SELECT doc_id, row_seq, CASE WHEN NOT (is_parent OR ref_no IN ('1', '01')) THEN '' WHEN fig_no::INT % 7 = 0 THEN 'NAME ' || fig_no ELSE 'ALL' END AS model_name FROM o",
    "j9_flag_edits": f"{RUNS} SELECT doc_id, row_seq, CASE WHEN has = 0 OR run_offset > 5 THEN '' WHEN fig_no::INT % 5 = 0 AND run_offset = 0 THEN 'E0' WHEN fig_no::INT % 5 = 0 AND run_offset = 2 THEN 'E2' WHEN run_offset = 0 THEN 'X' WHEN run_offset = 1 THEN 'ONE' WHEN run_offset = 3 THEN 'THREE' ELSE '' END AS remark_flag FROM o",
    "j11_figure_rows": f"{P} SELECT doc_id, row_seq FROM p WHERE fig_no = '3' OR upper(trim(fig_name)) = '1-URGENT'",
    "j14_completed": f"WITH job_events AS ({T.JOB_EVENTS}), {CAT} SELECT doc_id, row_seq FROM cat_rows WHERE doc_id IN (SELECT job_id FROM job_events WHERE status = 'completed')",
    "a3_a4_models_in_order": f"{P} SELECT DISTINCT doc_id, 'BGP1,BGP2' AS models, 2::INT AS n FROM p",
    "a2_figures": f"{P} SELECT doc_id, fig_no, arg_min(fig_name, page) AS fig_name, min(page) AS first_page FROM p GROUP BY 1, 2",
    "a16_a18_summary": f"{P} SELECT doc_id, count(DISTINCT page) AS pages, count(DISTINCT fig_no) AS figures, count(*) AS \"rows\", 2::BIGINT AS models, CASE WHEN doc_id % 10 = 3 THEN 'no text layer' ELSE 'ok' END AS status FROM p GROUP BY 1 UNION ALL SELECT (n_nationkey + 1000)::INT, 0, 0, 0, 0, 'no text layer' FROM nation",
    "s6_sheet": f"{RUNS} SELECT doc_id, row_seq, CASE WHEN starts THEN page::VARCHAR ELSE '' END AS page, CASE WHEN starts THEN fig_no ELSE '' END AS fig_no, '' AS item_group, CASE WHEN starts THEN fig_name ELSE '' END AS fig_name, '' AS show_in_website, '' AS ranking, '' AS catalogue_code, '' AS model_name, '' AS pic, '' AS pic_path, ref_no, part_no, description, qty1 AS \"BGP1\", qty2 AS \"BGP2\", remarks, CASE WHEN starts AND has = 1 THEN 'X' ELSE '' END AS remark_flag FROM o",
    "s7_model_sheets": f"{PM} SELECT doc_id, row_seq, 'Parts_' || model AS sheet, trim(q) AS quantity, 'YAM_' || model || '_' || upper(trim(regexp_replace(fig_name, '[^A-Za-z0-9&]+', ' ', 'g'))) || '.jpeg' AS pic FROM m WHERE {valid('q')}",
    "u3_s8_consolidated": f"{RUNS} SELECT doc_id, row_seq, {SUFFIXED} AS ref_no, 'BGP1' AS model_code FROM o",
    "u1_custom_sections": f"""{P}, l AS (SELECT doc_id, max(row_seq) AS last, arg_min(page, row_seq) FILTER (row_seq % 5 = 2) AS v, arg_min(page, row_seq) FILTER (row_seq % 7 = 3 AND row_seq % 14 <> 3) AS f FROM p GROUP BY 1), k AS (SELECT unnest(range(0, 25)) AS k),
 c AS (SELECT *, CASE k WHEN 0 THEN 'PART KITS & SETS' WHEN 10 THEN 'REGULAR SERVICE PARTS' END AS s FROM l CROSS JOIN k)
 SELECT doc_id, row_seq, fig_name, false AS is_custom_section, NULL::VARCHAR AS catalogue_code, NULL::VARCHAR AS item_group, CASE WHEN row_seq % 5 = 2 THEN 'YAHAMA BGP1 "R15 ' || page || '" Series HEAD' ELSE '' END AS model_name, CASE WHEN row_seq % 7 = 3 THEN 'x.jpeg' ELSE '' END AS pic,
  CASE WHEN row_seq % 14 = 3 THEN 'x.jpeg' WHEN row_seq % 7 = 3 THEN 'img/' || page || '/x.jpeg' ELSE '' END AS pic_path, qty1 AS q1 FROM p
 UNION ALL SELECT doc_id, last + 1 + k, coalesce(s, ''), true, coalesce('YAM_' || m || '_' || s, ''), CASE WHEN s IS NULL THEN '' ELSE m END, CASE WHEN s IS NULL THEN '' ELSE CASE WHEN v IS NULL THEN 'YAMAHA ' || m || ' ' ELSE 'YAHAMA ' || m || ' R15 ' || v || ' ' END || 'Series ' || s END,
  coalesce('YAM_' || m || '_' || s || '.jpeg', ''), CASE WHEN s IS NULL THEN '' ELSE CASE WHEN f IS NULL THEN '' ELSE 'img/' || f || '/' END || 'YAM_' || m || '_' || s || '.jpeg' END, '' FROM (SELECT *, CASE WHEN last >= 3 THEN 'BGP1' ELSE 'BGP1_BGP2' END AS m FROM c)""",
    "u2_backfill": f"{P} SELECT doc_id, row_seq, qty1 AS q1, CASE WHEN qty2 = '0' THEN '' ELSE qty2 END AS q2 FROM p",
    "u4_reconcile": f"{P} SELECT doc_id, row_seq, CASE WHEN {valid('qty1')} THEN qty1 ELSE '0' END AS q1, qty2 AS q3, 2::INT AS n FROM p",
    "u5_distinct_models": f"{PM} SELECT DISTINCT doc_id, model FROM m",
    "s5_union": f"{P} SELECT doc_id, row_seq, CASE WHEN doc_id < 32 THEN '' ELSE remarks END AS remarks FROM p",
    "s10_bundle": f"{PM}, doc_images AS ({T.DOC_IMAGES}), dm AS (SELECT DISTINCT doc_id, model FROM m) SELECT DISTINCT doc_id AS bundle, 'source.pdf' AS path, 'source' AS kind, NULL::BIGINT AS size FROM dm UNION ALL SELECT DISTINCT doc_id, 'summary.txt', 'summary', NULL FROM dm UNION ALL SELECT doc_id, model || '/xlsx/Parts_' || model || '.xlsx', 'sheet', NULL FROM dm UNION ALL SELECT doc_id, 'images/' || filename, 'image', size_bytes FROM doc_images UNION ALL SELECT i.doc_id, model || '/images/' || regexp_replace(filename, '^YAM_[A-Za-z0-9]+?_', 'YAM_' || model || '_'), 'model_image', size_bytes FROM doc_images i JOIN dm ON i.doc_id = dm.doc_id",
    "s11_processing_summary": f"{PM}, doc_images AS ({T.DOC_IMAGES}), c AS (SELECT doc_id, count(*) AS images FROM doc_images GROUP BY 1) SELECT m.doc_id, model, count_if({valid('q')})::BIGINT AS parts, coalesce(any_value(images), 0)::BIGINT AS images FROM m LEFT JOIN c ON m.doc_id = c.doc_id GROUP BY 1, 2",
    "f16_image_search": f"{IMAGES} SELECT image_id FROM doc_images WHERE lower(filename) LIKE '%img1%' AND NOT {BIKE}",
    "f17_f19_admitted_images": f"{IMAGES} SELECT image_id, fig_no FROM i WHERE CASE WHEN fig_no IS NOT NULL THEN greatest(width, height) >= 100 AND least(width, height) >= 40 ELSE least(width, height) >= 150 END AND (fig_no IS NOT NULL OR {BIKE})",
    "f18_unmasked": f"{IMAGES} SELECT image_id FROM doc_images d WHERE NOT EXISTS (SELECT 1 FROM doc_images m WHERE m.image_id % 6 = 0 AND m.doc_id = d.doc_id AND m.page = d.page AND m.filename = d.filename)",
    "j3_image_figures": f"{IMAGES} SELECT image_id, fig_no FROM i WHERE (doc_id <> 3 AND fig_no IS NOT NULL) OR (doc_id = 3 AND page % 2 = 1)",
    "j13_images_of_models": f"{PM}, doc_images AS ({T.DOC_IMAGES}) SELECT image_id, model, regexp_replace(filename, '^YAM_[A-Za-z0-9]+?_', 'YAM_' || model || '_') AS filename FROM doc_images i JOIN (SELECT DISTINCT doc_id, model FROM m) x ON i.doc_id = x.doc_id",
    "w11_unique_images": f"{IMAGES} SELECT image_id, h AS sha256 FROM (SELECT *, sha256(payload) AS h, row_number() OVER (PARTITION BY doc_id, sha256(payload) ORDER BY page, image_id) AS n FROM doc_images) WHERE n = 1",
    "w12_s8_s10_probed_names": f"""WITH f AS (SELECT *, CASE WHEN regexp_matches(filename, '(?i)[.](jpeg|png)$') THEN filename ELSE filename || '.jpeg' END AS name, substr(title, 1, 31) AS sheet FROM ({T.NAMED_FILES})),
 g AS (SELECT bundle, list(file_id ORDER BY file_id) AS ids, list([name] ORDER BY file_id) AS names, list([sheet] ORDER BY file_id) AS sheets FROM f GROUP BY 1),
 h AS (SELECT ids, list_reduce(names, lambda a, x: list_concat(a, [CASE WHEN NOT list_contains(list_transform(a, lambda y: lower(y)), lower(x[1])) THEN x[1] ELSE list_filter(list_transform(range(1, len(a) + 2), lambda k: regexp_extract(x[1], '^(.*)[.]', 1) || '_' || k || regexp_extract(x[1], '[.][^.]*$')), lambda c: NOT list_contains(list_transform(a, lambda y: lower(y)), lower(c)))[1] END])) AS names,
  list_reduce(sheets, lambda a, x: list_concat(a, [CASE WHEN NOT list_contains(a, x[1]) THEN x[1] ELSE list_filter(list_transform(range(1, len(a) + 2), lambda k: substr(substr(x[1], 1, 28) || '_' || k, 1, 31)), lambda c: NOT list_contains(a, c))[1] END])) AS sheets FROM g)
 SELECT unnest(ids) AS file_id, unnest(names) AS filename, unnest(sheets) AS title FROM h""",
    "w12_names": f"{IMAGES} SELECT image_id, CASE WHEN n = 1 THEN filename ELSE filename || '_' || n END AS filename FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, filename ORDER BY image_id) AS n FROM doc_images)",
    "a19_image_counts": f"{IMAGES} SELECT doc_id, count(*) AS images, count_if({BIKE})::BIGINT AS bikes, count_if(NOT {BIKE})::BIGINT AS parts FROM doc_images GROUP BY 1",
    "a20_image_pages": f"{IMAGES} SELECT DISTINCT doc_id, page FROM doc_images",
    "a13_cart_lines": f"{CART} SELECT cart_id, part_no, description, ref_no, fig_no, fig_name, qty::BIGINT AS qty, price, gst FROM lines",
    "a14_cart_totals": f"{CART} SELECT cart_id, sum(qty)::BIGINT AS qty, round(sum(qty * price), 4) AS subtotal, round(sum(qty * price * gst / 100), 4) AS gst_total, round(sum(qty * price + qty * price * gst / 100), 4) AS grand_total FROM lines GROUP BY 1",
    "s9_quotation": f"{CART} SELECT cart_id, ref_no, part_no::VARCHAR AS part_no, description, 'FIG. ' || fig_no || ' - ' || fig_name AS figure, qty::BIGINT::VARCHAR AS qty, printf('%.2f', price) AS unit_mrp, CASE WHEN gst = floor(gst) THEN gst::INT::VARCHAR ELSE gst::VARCHAR END || '%' AS gst, printf('%.2f', qty * price * (1 + gst / 100)) AS total FROM lines",
    "t1_progress_changes": f"{JOBS}, a AS (SELECT *, lag(page) OVER w AS pp, lag(status) OVER w AS ps, coalesce(max((status IN ('completed', 'error'))::INT) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) SELECT job_id, event_id, status, page FROM a WHERE ended = 0 AND (ps IS NULL OR pp <> page OR ps <> status)",
    "t2_latest_status": f"{JOBS} SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(page, (ts, event_id)) AS page, count(*) AS events FROM job_events GROUP BY 1",
    "t3_expired": f"{JOBS} SELECT job_id, CASE WHEN arg_max(status, (ts, event_id)) = 'processing' THEN 'error' ELSE 'expired' END AS outcome FROM job_events GROUP BY 1 HAVING floor(epoch((SELECT max(ts) FROM job_events))) - floor(epoch(min(ts))) > 1728000",
    "a15_batch_totals": f"{JOBS}, l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(page, (ts, event_id)) AS page, count(*) AS n FROM job_events GROUP BY 1) SELECT count_if(status = 'completed')::BIGINT AS completed, sum(n)::BIGINT AS \"rows\", sum(page)::BIGINT AS images FROM l",
    "w1_a8_x13_lines": f"WITH {CAT}, w AS (WITH {T.CAT_WORDS}), g AS (SELECT *, (top - lag(top, 1, top) OVER (PARTITION BY doc_id, page ORDER BY top) > 2)::INT AS new FROM w), l AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id, page ORDER BY top))::INT AS line_no FROM g) SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY x0, text) AS text FROM l GROUP BY 1, 2, 3",
    "a9_a10_page_columns": f"WITH {CAT} SELECT DISTINCT doc_id, page, 'BGP1,BGP2' AS models FROM cat_rows",
    "w3_j1_j2_x16_x17_extracted": f"WITH {CAT} SELECT doc_id, row_seq, page, fig_no, fig_name, ref_no, {X2} AS part_no, {X3} AS description, {X4} AS remarks, qty1 AS q1, qty2 AS q2 FROM cat_rows",
    "j10_chosen_images": f"{IMAGES}, k AS (SELECT doc_id, CASE WHEN image_id % 2 = 0 THEN image_id::VARCHAR ELSE filename END AS pick FROM doc_images WHERE image_id % 13 = 0 AND doc_id <> 2), h AS (SELECT DISTINCT d.image_id, d.doc_id FROM doc_images d JOIN k ON k.doc_id = d.doc_id AND (k.pick = d.image_id::VARCHAR OR k.pick = d.filename)) SELECT image_id FROM doc_images WHERE image_id IN (SELECT image_id FROM h) OR doc_id NOT IN (SELECT doc_id FROM h)",
    "s2_ocr_words": f"WITH {CAT}, w AS (WITH {T.CAT_WORDS}) SELECT doc_id || '-' || page AS file, trim(text) AS text, trunc(x0) / 2 AS x0, trunc(top) / 2 AS top, (trunc(x0) + 20) / 2 AS x1, (trunc(top) + 7) / 2 AS bottom FROM w WHERE x0 <= 500 AND x0 <> 150",
    "x20_x30_file_codes": rf"WITH {CAT}, n AS (SELECT doc_id, row_seq, description, regexp_extract(upper(fig_name || ' ' || ['book', 'Edit', 'temp', 'catalogue', 'a_list'][row_seq % 5 + 1] || ' x' || page || 'y bgp1.pdf'), '\b([A-Z0-9]{{4}})\b', 1) AS c, regexp_extract_all(upper(fig_name || ' ' || ['book', 'Edit', 'temp', 'catalogue', 'a_list'][row_seq % 5 + 1] || ' x' || page || 'y bgp1.pdf'), '\b([A-Z0-9]{{3,6}})\b', 1) AS l FROM cat_rows) SELECT doc_id, row_seq, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: x[1] NOT IN ('PARTS', 'CATALOGUE', 'CATALOG', 'YAMAHA', 'INDIA', 'MODEL') AND list_position(l, x[1]) = x[2]), lambda x: x[1]), ',') AS codes, coalesce(l[1], 'MODEL') AS short_code, CASE WHEN c IN ('PART', 'PAGE', 'BOOK', 'EDIT', 'FILE', 'LIST', 'TEMP') THEN '' ELSE c END AS code, regexp_matches(description, '(?i)\bbike\b|_bike') AS bike FROM n",
    "a12_pixel_colors": PIXELS,
    "a12_raster_colors": RASTERS,
    "x22_color_info": "SELECT p_partkey, p_partkey % 2 = 0 AS is_bike_color, CASE WHEN p_partkey % 2 = 1 THEN '' WHEN p_partkey % 3 = 0 THEN 'MAT BLACK' ELSE 'RACING BLUE' END AS color_name, CASE WHEN p_partkey % 2 = 0 THEN 'C' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') ELSE '' END AS color_code FROM part",
    "j6_matched_colors": f"{IMAGES}, c AS (SELECT n_nationkey % 8 AS doc_id, n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'MAT BLACK' WHEN 1 THEN 'RACING BLUE' ELSE 'VIVID RED' END AS name FROM nation) SELECT image_id, arg_min(name, k) AS color_name, lpad(min(k)::VARCHAR, 4, '0') AS color_code FROM doc_images d LEFT JOIN c ON d.doc_id = c.doc_id AND name LIKE '%' || CASE WHEN image_id % 3 = 0 THEN 'BLACK' WHEN image_id % 2 = 0 THEN 'RED' ELSE 'BLUE' END || '%' GROUP BY 1",
    "j5_text_below": f"WITH {CAT}, w AS (WITH {T.CAT_WORDS}), doc_images AS ({T.DOC_IMAGES}), l AS (SELECT image_id, round_even(top / 4, 0) AS y, string_agg(text, ' ' ORDER BY w.x0, text) AS line FROM doc_images JOIN w USING (doc_id, page) WHERE top BETWEEN 102 AND 260 AND w.x1 >= 150 AND w.x0 <= 470 GROUP BY 1, 2) SELECT image_id, string_agg(line, '|' ORDER BY y, line) AS lines FROM l GROUP BY 1",
    "x23_x24_color_table": "SELECT c_custkey AS doc_id, 1::INT AS entry_order, 'AB' || c_custkey % 10 AS abbrev, 'RACING BLUE' AS color_name, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS color_code FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 9 BETWEEN 1 AND 6",
    "j7_w13_w14_x18_format_b": f"""WITH {CAT}, n AS (SELECT DISTINCT doc_id, page, CASE WHEN page % 5 = 0 THEN NULL ELSE fig_name END AS name FROM cat_rows),
 a AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS now FROM n),
 b AS (SELECT *, row_number() OVER w = 1 OR (now IS NOT NULL AND now IS DISTINCT FROM lag(now) OVER w) AS new FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
 f AS (SELECT doc_id, page, now, (sum(new::INT) OVER (PARTITION BY doc_id ORDER BY page))::INT::VARCHAR AS figure FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_seq) AS band, CASE WHEN row_seq % 4 <> 0 THEN ref_no END AS own FROM cat_rows)
SELECT doc_id, page, figure AS fig_no, coalesce(now, 'FIG ' || figure) AS fig_name, band::INT AS band, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, figure ORDER BY page, band), '') AS ref_no, {X2} AS part_no, {X3} AS description, qty1 AS qty, {X4} AS remarks FROM r JOIN f USING (doc_id, page)""",
    "t4_ingested": f"WITH {CAT} SELECT doc_id, row_seq, page, fig_no, ref_no, {X2} AS part_no, qty1 AS q1, qty2 AS q2 FROM cat_rows",
    "s4_json_rows": f"WITH {CAT} SELECT doc_id, row_seq, page, part_no, qty1 AS q1, qty2 AS q2 FROM cat_rows",
    "s3_manifest": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'bad_format' WHEN doc_id % 5 = 0 THEN 'empty' WHEN n_chars > 5000 THEN 'too_large' ELSE 'accepted' END AS status FROM documents",
}
ORACLE_SQL |= {"t1_streamed_changes": ORACLE_SQL["t1_progress_changes"], "t2_streamed_latest": ORACLE_SQL["t2_latest_status"]}

# Constants as the catalogue's rules state them, not taken from the operators.
FACTS = f"""WITH doc_images AS ({T.DOC_IMAGES}), page_figures AS ({T.PAGE_FIGURES.replace('page / 2', 'page // 2')}),
 c AS (SELECT n_nationkey % 8 AS doc_id, n_nationkey AS o, ['Mat Black', 'RACING BLUE', 'VIVID RED'][n_nationkey % 3 + 1] AS name, lpad(n_nationkey::VARCHAR, 4, '0') AS code FROM nation),
 i AS (SELECT doc_id, image_id, page, fig_no, CASE WHEN fig_no IS NULL THEN NULL WHEN page % 4 = 0 THEN '' ELSE fig_name || ' / Left: 1' END AS fig_name, width, height, fig_no IS NULL AND image_id % 11 <> 0 AS sound, image_id % 7 = 0 AS black FROM doc_images LEFT JOIN page_figures USING (doc_id, page)),
 s AS (SELECT *, sound AND image_id % 5 = 0 AS said, sound AND image_id % 5 <> 0 AND (page <= 3 OR page % 9 = 0) AND width >= 120 AND height >= 80 AND (black OR image_id % 4 <> 1) AS seen FROM i),
 h AS (SELECT s.image_id, arg_min(name, o) AS name, arg_min(code, o) AS code FROM s JOIN c ON s.doc_id = c.doc_id AND seen AND contains(upper(name), CASE WHEN black THEN 'BLACK' WHEN s.image_id % 2 = 0 THEN 'RED' ELSE 'GREEN' END) GROUP BY 1),
 b AS (SELECT s.*, said OR seen AS is_bike, CASE WHEN said THEN CASE WHEN s.image_id % 2 = 0 THEN 'Racing Blue 9' ELSE '' END WHEN h.name IS NOT NULL THEN h.name WHEN seen AND black THEN 'MAT BLACK' ELSE '' END AS color_name,
  CASE WHEN said THEN ['BLUE', '05-82', ''][s.image_id % 3 + 1] WHEN h.name IS NOT NULL THEN h.code ELSE '' END AS color_code FROM s LEFT JOIN h USING (image_id))"""
_PLAIN = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', '_', 'g'), '_')"
KEYWORDS = "['YAMAHA', 'PARTS', 'CATALOGUE', 'CATALOG', 'FIG', 'CYLINDER', 'DESCRIPTION', 'REMARKS', 'PART', 'REF', 'MODEL', 'HEAD', 'CRANKSHAFT', 'VALVE', 'COVER', 'ASSY']"
ORACLE_SQL |= {
    "x25_bikes": f"{FACTS} SELECT image_id, is_bike, color_name, color_code FROM b",
    "x25_x26_image_names": f"""{FACTS}, p AS (SELECT *, {_PLAIN.format('color_name')} AS n, {_PLAIN.format('color_code')} AS k, sum(is_bike::INT) OVER (PARTITION BY doc_id ORDER BY page, image_id) AS nth, row_number() OVER (PARTITION BY doc_id, page ORDER BY image_id) AS i FROM b),
 f AS (SELECT *, 'YAM_BGP1_' || CASE WHEN is_bike THEN 'BIKE' || CASE WHEN k <> '' AND NOT contains(n, k) THEN '_' || k ELSE '' END || CASE WHEN n <> '' THEN '_' || n ELSE '' END || CASE WHEN n = '' AND k = '' AND nth > 1 THEN '_' || nth::BIGINT ELSE '' END
  WHEN fig_no IS NULL THEN 'PAGE_' || page || '_IMG_' || i WHEN fig_name = '' THEN 'FIG_' || CASE WHEN length(fig_no) = 1 THEN '0' || fig_no ELSE fig_no END ELSE trim(regexp_replace(regexp_replace(fig_name, '[/:*?"<>|]', ' ', 'g'), ' +', ' ', 'g')) END AS name FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_bike, fig_no, name ORDER BY page, image_id) AS again FROM f)
SELECT image_id, name || CASE WHEN again > 1 THEN '_' || again ELSE '' END AS filename, CASE WHEN is_bike THEN 'BIKE' ELSE fig_no END AS fig_no,
 CASE WHEN NOT is_bike THEN fig_name WHEN color_name <> '' AND color_code <> '' THEN color_name || ' (' || color_code || ')' WHEN color_name <> '' THEN color_name WHEN color_code <> '' THEN 'BIKE ' || color_code ELSE 'BIKE PHOTO' END AS fig_name FROM r""",
    "j4_placements": f"{IMAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY image_id) AS o FROM doc_images), c AS (SELECT a.image_id, CASE WHEN b.image_id % 3 = 0 AND a.filename = b.filename THEN 1 WHEN b.image_id % 3 = 1 AND a.width = b.width AND a.height = b.height THEN 2 WHEN a.o = b.o THEN 3 END AS rule, b.o, b.image_id AS box_of FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.page = b.page) SELECT image_id, arg_min(box_of, (rule, o)) AS box_of, min(rule)::INT AS rule FROM c WHERE rule IS NOT NULL GROUP BY 1",
    "x21_row_models": f"WITH {CAT}, m AS (SELECT doc_id, row_seq, CASE page % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'MODEL' ELSE 'BGPK' END WHEN 1 THEN 'BG' ELSE 'BGP2' END AS m, CASE WHEN doc_id % 2 = 0 THEN 'DH71' WHEN doc_id % 5 = 0 THEN 'R15' ELSE '' END AS c FROM cat_rows) SELECT doc_id, row_seq, CASE WHEN length(m) < 4 AND length(c) = 4 THEN c WHEN m = 'MODEL' AND c <> '' THEN c ELSE m END AS model FROM m",
    "a11_rotations": f"""WITH o AS (SELECT (o_custkey % 500) AS doc_id, (o_orderkey % 2)::INT AS page, (o_orderkey % 4 * 90)::INT AS angle, max(CASE o_orderkey % 6 WHEN 0 THEN 'Yamaha parts catalogue head valve' WHEN 1 THEN 'cylinder head cover assy ref description remarks model fig part crankshaft' ELSE 'some words' END) AS text, bool_and(o_orderkey % 10 = 0) AS heading FROM orders GROUP BY 1, 2, 3),
 s AS (SELECT *, list_sum(list_transform({KEYWORDS}, lambda w: contains(upper(text), w)::INT)) + 15 * heading::INT + 10 * contains(upper(text), 'PARTS CATALOG')::INT AS score FROM o),
 p AS (SELECT doc_id, page, max(score) FILTER (angle = 0) AS zero, max(score) AS best, arg_max(angle, (score, -angle)) AS angle FROM s GROUP BY 1, 2),
 a AS (SELECT doc_id, page, CASE WHEN zero >= 15 THEN 0 WHEN best >= 10 THEN angle END AS angle FROM p)
SELECT doc_id, coalesce(arg_min(angle, page) FILTER (angle IS NOT NULL), 0)::INT AS angle FROM a GROUP BY 1""",
    "x14_spare_headings": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey % 40 || ':' WHEN 2 THEN (p_partkey % 40)::VARCHAR WHEN 3 THEN '' END AS fig_no, CASE WHEN p_partkey % 5 IN (0, 2, 3) THEN upper(regexp_extract(p_name, '^([a-z]+)', 1)) END AS fig_name FROM part",
    "x19_w15_cover_models": "SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'LCX125D' WHEN 1 THEN 'EC-06' ELSE 'ABCD' END AS name, CASE WHEN c_custkey % 3 = 2 THEN 'ABCD' ELSE chr((65 + c_custkey % 26)::INT) || 'X' || c_custkey % 10 || chr((65 + c_custkey % 7)::INT) END AS code FROM customer",
    "t3_streamed_expired": ORACLE_SQL["t3_expired"],
}

"""Every query of the layout engine by name, over the whole test tables, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import alignment, layer, matching, ordering, refine, responses
from quire.plans.derived import LINES_OF, SIX, SPACE, STRIP, boxes, line_arrays, lines, predictions, six, sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def flat(df: DataFrame, box: str = "box", more: str = "") -> DataFrame:
    """Boxes as four columns of six decimals."""
    return df.select(*[c for c in df.columns if c != box], *(six(F.col(box)[e]).alias(f"{more}{e}") for e in G.EDGES))


FLAT = ", ".join(f"{SIX(e)} AS {e}" for e in G.EDGES)

# --- text ------------------------------------------------------------------


@query("t01_lines_normalize", sql("SELECT doc_id, line_idx, text FROM v_lines"))
def _(spark, sf):
    return lines(docs(spark, sf))


FRONT = f"""
fm AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'primary_language: en' || chr(10) || '---' || chr(10) || chr(10) || text
                           WHEN doc_id % 3 = 1 THEN '---' || chr(10) || 'left open ' || text ELSE text END AS raw FROM documents),
st AS (SELECT doc_id, raw, regexp_replace(raw, '^{SPACE}+', '') AS started FROM fm),
cl AS (SELECT *, substring(started, 4) AS rest, instr(substring(started, 4), chr(10) || '---') AS ends FROM st),
body AS (SELECT doc_id, CASE WHEN starts_with(started, '---') AND ends > 0 THEN {STRIP("regexp_replace(substring(rest, ends + 4), '^' || chr(10) || '+', '')")} ELSE raw END AS text FROM cl)
"""


def fronted(spark, sf) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\nprimary_language: en\n---\n\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("---\nleft open "), "text")).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", head.alias("text"))


@query("t02_front_matter_strip", f"WITH {FRONT.strip()} SELECT doc_id, text FROM body")
def _(spark, sf):
    return fronted(spark, sf).select("doc_id", X.without_front_matter(F.col("text")).alias("text"))


@query(
    "t03_page_response_lines",
    f"""WITH {FRONT.strip()},
    l AS (SELECT doc_id, {LINES_OF("text")} AS ls FROM body),
    e AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_idx, unnest(ls) AS text FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY line_idx) AS nth FROM e)
    SELECT doc_id, line_idx, text FROM r WHERE nth <= 20""",
)
def _(spark, sf):
    found = fronted(spark, sf).select("doc_id", F.posexplode(X.lines(X.without_front_matter(F.col("text")))).alias("line_idx", "text"))
    return responses.clipped(found, ["doc_id"], "line_idx")


CROPS = """CASE WHEN conv_id % 13 = 0 THEN ' "The quick brown fox jumps over the lazy dog." ' || chr(10)
     WHEN conv_id % 13 = 1 THEN 'Quoted: lorem ipsum, as they say' WHEN conv_id % 13 = 2 THEN chr(8220) || 'Lorem Ipsum' || chr(8221) ELSE text END"""


def crops(spark, sf) -> DataFrame:
    k = F.col("conv_id") % 13
    raw = F.when(k == 0, F.lit(' "The quick brown fox jumps over the lazy dog." \n')).when(k == 1, F.lit("Quoted: lorem ipsum, as they say")).when(k == 2, F.lit("“Lorem Ipsum”")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))


JOIN = f"array_to_string({LINES_OF('raw')}, ' ')"
MARKS = "'.!?\"''`)([]{}<>' || chr(8220) || chr(8221) || chr(8216) || chr(8217) || ' ' || chr(9)"


@query("t04_crop_join", f"SELECT conv_id, turn, {JOIN} AS text FROM (SELECT conv_id, turn, {CROPS} AS raw FROM conversations)")
def _(spark, sf):
    return crops(spark, sf).select("conv_id", "turn", X.joined(F.col("raw")).alias("text"))


@query(
    "f05_fallback_filter",
    f"""SELECT conv_id, turn, CASE WHEN trim(lower(text), {MARKS}) IN ('the quick brown fox jumps over the lazy dog', 'lorem ipsum') THEN '' ELSE text END AS text
    FROM (SELECT conv_id, turn, {JOIN} AS text FROM (SELECT conv_id, turn, {CROPS} AS raw FROM conversations))""",
)
def _(spark, sf):
    return crops(spark, sf).select("conv_id", "turn", X.crop_text(F.col("raw")).alias("text"))


@query("t05_dedup_norm", sql(f"SELECT doc_id, line_idx, {STRIP(f'''regexp_replace(lower(text), '{SPACE}+', ' ', 'g')''')} AS text FROM v_lines"))
def _(spark, sf):
    return lines(docs(spark, sf)).select("doc_id", "line_idx", X.dedup_form(F.col("text")).alias("text"))


@query("t06_eval_norm", sql(f"SELECT doc_id, line_idx, {STRIP(f'''regexp_replace(regexp_replace(lower(text), '[*_`#-]+', ' ', 'g'), '{SPACE}+', ' ', 'g')''')} AS text FROM v_lines"))
def _(spark, sf):
    return lines(docs(spark, sf)).select("doc_id", "line_idx", X.evaluation_form(F.col("text")).alias("text"))


LOOPED = sql(
    "",
    """looped AS (SELECT doc_id, line_idx * 100 + k AS pos, text FROM v_lines, range(25) g(k) WHERE k = 0 OR (doc_id % 11 = 0 AND line_idx = 1)),
    nthd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM looped)""",
)


def looped(spark, sf) -> DataFrame:
    again = (F.col("doc_id") % 11 == 0) & (F.col("line_idx") == 1)
    copies = F.when(again, F.sequence(F.lit(0), F.lit(24))).otherwise(F.array(F.lit(0)))
    return lines(docs(spark, sf)).withColumn("k", F.explode(copies)).select("doc_id", (F.col("line_idx") * 100 + F.col("k")).cast("bigint").alias("pos"), "text")


@query("w01_runaway_clip", LOOPED + "SELECT doc_id, pos, text FROM nthd WHERE nth <= 20")
def _(spark, sf):
    return responses.clipped(looped(spark, sf), ["doc_id"], "pos")


@query(
    "a06_repeat_topk",
    LOOPED + """SELECT doc_id, text, n, first, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INTEGER) AS rank
    FROM (SELECT doc_id, text, count(*) AS n, min(pos) AS first FROM looped GROUP BY ALL)) WHERE rank <= 5""",
)
def _(spark, sf):
    return responses.most_repeated(looped(spark, sf), ["doc_id"], "pos")


@query("s01_input_kind", r"SELECT page_id, path, coalesce(lower(regexp_extract(path, '[^/.][^/]*\.([^./]+)$', 1)) IN ('avif','bmp','jpeg','jpg','png','tif','tiff','webp'), false) AS is_image FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '.PNG' WHEN 1 THEN '/tmp/.jpg' WHEN 2 THEN 'scan.' || page_id || '.tiff' ELSE url END AS path FROM pages)")
def _(spark, sf):
    return page_paths(spark, sf).select("page_id", "path", X.is_image(F.col("path")).alias("is_image"))


def page_paths(spark, sf) -> DataFrame:
    p = F.col("page_id")
    path = F.when(p % 4 == 0, F.concat("url", F.lit(".PNG"))).when(p % 4 == 1, F.lit("/tmp/.jpg")).when(p % 4 == 2, F.concat(F.lit("scan."), p.cast("string"), F.lit(".tiff"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query("t19_output_path", r"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'out/' || page_id || '.pdf' ELSE regexp_replace(path, '([^/])\.[^./]*$', '\1') || '_ocr.pdf' END AS out FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '.PNG' WHEN 1 THEN '/tmp/.jpg' WHEN 2 THEN 'scan.' || page_id || '.tiff' ELSE url END AS path FROM pages)")
def _(spark, sf):
    given = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("out/"), F.col("page_id").cast("string"), F.lit(".pdf"))).otherwise(F.lit(""))
    return page_paths(spark, sf).select("page_id", X.output_path(F.col("path"), given).alias("out"))


@query("t22_snippet", sql("SELECT doc_id, replace(substring(text, 1, 80), chr(10), ' ') AS head FROM documents"))
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.snippet(F.col("text"), 80).alias("head"))


SPECS = [("3", 10), ("1-3", 10), ("1-3,5,7-9", 10), ("8-12", 5), ("1,1,2-3,3", 5), ("3-1", 9), (" 2 , ", 9), ("0", 9), ("6-6", 5), ("", 5), ("2-4, 9-20 ,1", 12)]


@query(
    "f01_page_range",
    """WITH specs(spec, total) AS (VALUES """ + ", ".join(f"('{s}', {n})" for s, n in SPECS) + """),
    parts AS (SELECT spec, total, trim(unnest(string_split(spec, ','))) AS p FROM specs),
    ends AS (SELECT spec, total, CAST(split_part(p, '-', 1) AS INTEGER) AS a, CAST(CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END AS INTEGER) AS b FROM parts WHERE p <> '')
    SELECT DISTINCT spec, CAST(k - 1 AS INTEGER) AS page_index FROM (SELECT spec, unnest(range(greatest(a, 1), least(b, total) + 1)) AS k FROM ends)""",
)
def _(spark, sf):
    specs = spark.createDataFrame(SPECS, "spec string, total int")
    return specs.select("spec", F.explode(X.page_numbers(F.col("spec"), F.col("total"))).alias("page_index"))


@query("j01_page_selection", "SELECT conv_id, turn, text FROM conversations WHERE turn IN (0, 1, 2, 4) AND turn < 40")
def _(spark, sf):
    chosen = spark.range(1).select(F.explode(X.page_numbers(F.lit("1-3,5"), F.lit(40))).alias("turn"))
    return table(spark, sf, "conversations").join(chosen, "turn", "left_semi").select("conv_id", "turn", "text")


# --- geometry --------------------------------------------------------------

CORNERS = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 3000::DOUBLE AS {e}" for i, e in enumerate(G.EDGES)) + " FROM embeddings"


def corners(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", G.box(*(F.get("embedding", F.lit(i)).cast("double") * 3000.0 for i in range(4))).alias("box"))


def clamp_sql(x: str, side: str) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {x} / {side}::DOUBLE))"


NORMAL = ", ".join(f"{clamp_sql(e, '1700' if e[0] == 'x' else '2200')} AS {e}" for e in G.EDGES)


@query("g02_clamp_norm", f"SELECT vec_id, {FLAT} FROM (SELECT vec_id, {NORMAL} FROM ({CORNERS}))")
def _(spark, sf):
    return flat(corners(spark, sf).select("vec_id", G.normalized(F.col("box"), F.lit(1700.0), F.lit(2200.0)).alias("box")))


@query("g04_denorm_round", f"SELECT vec_id, {', '.join(f'CAST(round_even({e} * {1701 if e[0] == 'x' else 2201}::DOUBLE * 0.5::DOUBLE, 0) AS INTEGER) AS {e}' for e in G.EDGES)} FROM (SELECT vec_id, {NORMAL} FROM ({CORNERS}))")
def _(spark, sf):
    b = F.col("box")
    unit = corners(spark, sf).select("vec_id", G.normalized(b, F.lit(1700.0), F.lit(2200.0)).alias("box"))
    return unit.select("vec_id", *(G.rounded(b[e] * F.lit(1701.0 if e[0] == "x" else 2201.0) * 0.5).alias(e) for e in G.EDGES))


@query("g21_refinable_gate", sql("SELECT doc_id, box_idx, (x1 - x0 > 0.03::DOUBLE AND y1 - y0 > 0.008::DOUBLE) AS refinable FROM v_boxes"))
def _(spark, sf):
    return boxes(docs(spark, sf)).select("doc_id", "box_idx", G.refinable(F.col("box")).alias("refinable"))


@query("f04_dense_router", sql("SELECT doc_id, count(*) AS n_boxes, count(*) > 60 AS dense FROM v_boxes GROUP BY doc_id"))
def _(spark, sf):
    return refine.dense_pages(boxes(docs(spark, sf)))


CAP = """caps AS (SELECT *, greatest(1e-6::DOUBLE, (x1 - x0) * (y1 - y0)) AS cap FROM v_boxes),
tot AS (SELECT doc_id, list_reduce(list_prepend(0::DOUBLE, list(cap ORDER BY box_idx)), lambda a, b: a + b) AS total, greatest(1, sum(length(text))) AS chars FROM caps GROUP BY doc_id),
shares AS (SELECT c.doc_id, c.box_idx, c.text, c.cap / t.total * CAST(t.chars AS DOUBLE) AS expected FROM caps c JOIN tot t USING (doc_id))"""


def shares(found: DataFrame) -> DataFrame:
    held = found.withColumn("cap", G.capacity(F.col("box")))
    total = held.groupBy("doc_id").agg(
        F.expr("aggregate(array_sort(collect_list(struct(box_idx, cap))), 0D, (a, x) -> a + x.cap)").alias("total"), F.greatest(F.lit(1), F.sum(F.length("text"))).cast("double").alias("chars")
    )
    return held.join(total, "doc_id").withColumn("expected", F.col("cap") / F.col("total") * F.col("chars"))


@query("g06_capacity_share", sql(f"SELECT doc_id, box_idx, {SIX('expected')} AS expected FROM shares", CAP))
def _(spark, sf):
    return shares(boxes(docs(spark, sf))).select("doc_id", "box_idx", six(F.col("expected")).alias("expected"))


@query("n03_match_cost", sql(f"SELECT doc_id, box_idx, {SIX('CASE WHEN a > e THEN (a - e) / a ELSE (e - a) / e * 0.5::DOUBLE END')} AS cost FROM (SELECT doc_id, box_idx, greatest(1::DOUBLE, expected) AS e, greatest(1::DOUBLE, CAST(length(text) AS DOUBLE)) AS a FROM shares)", CAP))
def _(spark, sf):
    held = shares(boxes(docs(spark, sf)))
    return held.select("doc_id", "box_idx", six(G.match_cost(F.length("text"), F.col("expected"))).alias("cost"))


CROP = """px AS (SELECT doc_id, box_idx, CAST(trunc(greatest(0::DOUBLE, least(1::DOUBLE, x0 - 0.005::DOUBLE)) * 1275) AS INTEGER) AS x0, CAST(trunc(greatest(0::DOUBLE, least(1::DOUBLE, y0 - 0.005::DOUBLE)) * 1650) AS INTEGER) AS y0,
 CAST(trunc(greatest(0::DOUBLE, least(1::DOUBLE, x1 + 0.005::DOUBLE)) * 1275) AS INTEGER) AS x1, CAST(trunc(greatest(0::DOUBLE, least(1::DOUBLE, y1 + 0.005::DOUBLE)) * 1650) AS INTEGER) AS y1 FROM v_boxes),
sz AS (SELECT *, CAST(x1 - x0 AS DOUBLE) AS cw, CAST(y1 - y0 AS DOUBLE) AS ch FROM px WHERE x1 > x0 AND y1 > y0),
sc AS (SELECT *, CASE WHEN cw < 256 OR ch < 256 THEN greatest(256::DOUBLE / cw, 256::DOUBLE / ch) ELSE 1::DOUBLE END AS scale FROM sz)"""


@query("g11_crop_rect", sql("SELECT doc_id, box_idx, x0, y0, x1, y1, CAST(trunc(cw * scale) AS INTEGER) AS w, CAST(trunc(ch * scale) AS INTEGER) AS h FROM sc", CROP))
def _(spark, sf):
    held = boxes(docs(spark, sf)).select("doc_id", "box_idx", G.crop_rect(F.col("box"), F.lit(1275), F.lit(1650)).alias("c")).where("not c.blank")
    held = held.select("doc_id", "box_idx", "c.*").drop("blank")
    size = G.crop_size((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"))
    return held.select("*", size.alias("s")).select("doc_id", "box_idx", *G.EDGES, "s.w", "s.h")


@query("g13_thumbnail", """SELECT vec_id, CASE WHEN m > 1024 THEN greatest(1, CAST(round_even(w * 1024::DOUBLE / m, 0) AS INTEGER)) ELSE w END AS w, CASE WHEN m > 1024 THEN greatest(1, CAST(round_even(h * 1024::DOUBLE / m, 0) AS INTEGER)) ELSE h END AS h
FROM (SELECT vec_id, w, h, greatest(w, h) AS m FROM (SELECT vec_id, CAST(200 + vec_id % 1900 AS INTEGER) AS w, CAST(150 + (7 * vec_id) % 2300 AS INTEGER) AS h FROM embeddings))""")
def _(spark, sf):
    v = F.col("vec_id")
    sized = table(spark, sf, "embeddings").select("vec_id", (v % 1900 + 200).cast("int").alias("w"), (v * 7 % 2300 + 150).cast("int").alias("h"))
    return sized.select("vec_id", G.thumbnail(F.col("w"), F.col("h"), 1024).alias("s")).select("vec_id", "s.w", "s.h")


INTER = "greatest(0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
PAIRS = f"""prs AS (SELECT a.doc_id, a.box_idx AS gt_idx, b.box_idx AS pred_idx, a.text AS gt_text, b.text AS pred_text, {INTER} AS inter,
  (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b FROM v_boxes a JOIN v_pred b ON a.doc_id = b.doc_id AND {INTER} > 0),
ious AS (SELECT *, inter / (area_a + area_b - inter) AS iou FROM prs)"""


def scored_pairs(spark, sf) -> DataFrame:
    truth = boxes(docs(spark, sf))
    return matching.meeting_pairs(truth.select("doc_id", "box_idx", "box"), predictions(truth).select("doc_id", "box_idx", "box"))


@query("g07_iou_pairs", sql(f"SELECT doc_id, gt_idx, pred_idx, {SIX('iou')} AS iou FROM ious", PAIRS))
def _(spark, sf):
    return scored_pairs(spark, sf).select("doc_id", F.col("l.box_idx").alias("gt_idx"), F.col("r.box_idx").alias("pred_idx"), six(G.iou(F.col("l.box"), F.col("r.box"))).alias("iou"))


@query("j08_overlap_join", sql(f"SELECT doc_id, gt_idx, pred_idx, {SIX('inter / greatest(1e-6::DOUBLE, area_a)')} AS share FROM prs WHERE inter / greatest(1e-6::DOUBLE, area_a) >= 0.5::DOUBLE", PAIRS))
def _(spark, sf):
    share = G.covered(F.col("l.box"), F.col("r.box"))
    return scored_pairs(spark, sf).where(share >= 0.5).select("doc_id", F.col("l.box_idx").alias("gt_idx"), F.col("r.box_idx").alias("pred_idx"), six(share).alias("share"))


@query("a07_axis_vote", sql("""SELECT doc_id, portrait, counted, CASE WHEN portrait > counted / 2 THEN 'yxyx' ELSE 'xyxy' END AS axes FROM (
  SELECT doc_id, count(*) FILTER (h > 1.5::DOUBLE * w AND w > 0 AND h > 0) AS portrait, count(*) FILTER (w > 0 AND h > 0) AS counted
  FROM (SELECT doc_id, abs(x1 - x0) AS w0, CASE WHEN doc_id % 3 = 0 THEN abs(y1 - y0) ELSE abs(x1 - x0) END AS w, CASE WHEN doc_id % 3 = 0 THEN abs(x1 - x0) ELSE abs(y1 - y0) END AS h FROM v_boxes) GROUP BY doc_id)"""))
def _(spark, sf):
    held = boxes(docs(spark, sf))
    return responses.axis_order(held.withColumn("box", F.when(F.col("doc_id") % 3 == 0, G.swapped(F.col("box"))).otherwise(F.col("box"))))


# --- matching --------------------------------------------------------------

GREEDY = PAIRS + """,
cands AS (SELECT doc_id, gt_idx, list(struct_pack(p := pred_idx, iou := iou) ORDER BY iou DESC, pred_idx) AS cs FROM ious GROUP BY ALL),
gts AS (SELECT b.doc_id, b.box_idx AS gt_idx, coalesce(c.cs, []) AS cs FROM v_boxes b LEFT JOIN cands c ON b.doc_id = c.doc_id AND b.box_idx = c.gt_idx),
walk AS (
  SELECT doc_id, CAST(-1 AS INTEGER) AS gt_idx, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS pred_idx, CAST(0 AS DOUBLE) AS iou FROM (SELECT DISTINCT doc_id FROM v_boxes)
  UNION ALL
  SELECT doc_id, gt_idx, CASE WHEN best.iou >= 0.3::DOUBLE THEN list_append(used, best.p) ELSE used END, CASE WHEN best.iou >= 0.3::DOUBLE THEN best.p END, coalesce(best.iou, 0)
  FROM (SELECT g.doc_id, g.gt_idx, w.used, list_filter(g.cs, lambda c: NOT list_contains(w.used, c.p))[1] AS best FROM walk w JOIN gts g ON g.doc_id = w.doc_id AND g.gt_idx = w.gt_idx + 1)),
matches AS (SELECT doc_id, gt_idx, pred_idx, iou FROM walk WHERE gt_idx >= 0)"""


def matched(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    truth = boxes(docs(spark, sf))
    found = predictions(truth)
    return matching.greedy_matches(truth, found), truth, found


@query("j05_greedy_match", sql(f"SELECT doc_id, gt_idx, pred_idx, {SIX('iou')} AS iou FROM matches", GREEDY, True))
def _(spark, sf):
    return matched(spark, sf)[0].withColumn("iou", six(F.col("iou")))


@query("a09_confidence_report", sql(f"""SELECT doc_id, gt_count, coalesce(pipeline_count, 0) AS pipeline_count, matched, {SIX('matched / greatest(1, gt_count)')} AS block_recall, {SIX('total / greatest(1, matched)')} AS avg_iou
FROM (SELECT doc_id, count(*) AS gt_count, count(*) FILTER (iou >= 0.3::DOUBLE) AS matched,
  list_reduce(list_prepend(0::DOUBLE, coalesce(list(iou ORDER BY gt_idx) FILTER (iou >= 0.3::DOUBLE), CAST([] AS DOUBLE[]))), lambda a, b: a + b) AS total FROM matches GROUP BY doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS pipeline_count FROM v_pred GROUP BY doc_id) USING (doc_id)""", GREEDY, True))
def confidence_report(spark, sf):
    found, _, predicted = matched(spark, sf)
    made = matching.report(found, predicted)
    return made.withColumn("block_recall", six(F.col("block_recall"))).withColumn("avg_iou", six(F.col("avg_iou")))


@query("f08_unmatched_head", sql(f"""SELECT doc_id, gt_idx, {SIX('iou')} AS iou, replace(substring(text, 1, 60), chr(10), ' ') AS head FROM (
  SELECT m.doc_id, m.gt_idx, m.iou, b.text, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.gt_idx) AS k FROM matches m JOIN v_boxes b ON b.doc_id = m.doc_id AND b.box_idx = m.gt_idx WHERE m.iou < 0.3::DOUBLE) WHERE k <= 6""", GREEDY, True))
def _(spark, sf):
    found, truth, _ = matched(spark, sf)
    missed = found.where("iou < 0.3").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("gt_idx"))).where("k <= 6")
    named = missed.join(truth.select("doc_id", F.col("box_idx").alias("gt_idx"), "text"), ["doc_id", "gt_idx"])
    return named.select("doc_id", "gt_idx", six(F.col("iou")).alias("iou"), X.snippet(F.col("text"), 60).alias("head"))


@query("j11_path_cross_jobs", "SELECT d.name AS document, p.name AS path FROM (VALUES ('digital'), ('handwritten'), ('hybrid'), ('image')) d(name), (VALUES ('grounded'), ('hybrid')) p(name)")
def _(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("digital", "handwritten", "hybrid", "image")], "document string")
    return names.select("document", F.explode(F.array(F.lit("grounded"), F.lit("hybrid"))).alias("path"))


# --- order and alignment -----------------------------------------------------


@query("w03_row_major_rank", sql("SELECT doc_id, box_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, box_idx) - 1 AS INTEGER) AS row_rank FROM v_boxes"))
def _(spark, sf):
    return ordering.row_major(boxes(docs(spark, sf))).select("doc_id", "box_idx", "row_rank")


GAPS = """ctr AS (SELECT *, (x0 + x1) / 2 AS centre FROM v_boxes),
plc AS (SELECT *, row_number() OVER w - 1 AS place, centre - lag(centre) OVER w AS gap FROM ctr WINDOW w AS (PARTITION BY doc_id ORDER BY centre, box_idx)),
wid AS (SELECT doc_id, count(*) AS members, max(gap) FILTER (gap > 0) AS widest FROM plc GROUP BY doc_id),
pos AS (SELECT doc_id, min(place) AS pl FROM plc JOIN wid USING (doc_id) WHERE gap = widest GROUP BY doc_id)"""


@query("w04_column_gap_split", sql(f"SELECT doc_id, members, {SIX('coalesce(widest, 0)')} AS gap, CAST(coalesce(pl, -1) AS INTEGER) AS place, (members >= 4 AND coalesce(widest, 0) >= 0.2::DOUBLE AND coalesce(pl, -1) >= 2 AND coalesce(pl, -1) <= members - 2) AS splits FROM wid LEFT JOIN pos USING (doc_id)", GAPS))
def _(spark, sf):
    gaps = ordering.column_gaps(boxes(docs(spark, sf)), ["doc_id"]).groupBy("doc_id").agg(F.max("members").alias("members"), F.max("gap").alias("gap"), F.max("at").alias("at"))
    splits = (F.col("members") >= 4) & (F.col("gap") >= 0.2) & (F.col("at") >= 2) & (F.col("at") <= F.col("members") - 2)
    return gaps.select("doc_id", "members", six(F.col("gap")).alias("gap"), F.col("at").alias("place"), splits.alias("splits"))


def _levels() -> str:
    """Column splits unrolled level by level."""
    out, last = ["k0 AS (SELECT doc_id, box_idx, x0, y0, (x0 + x1) / 2 AS centre, '' AS path, true AS open FROM v_boxes)"], "k0"
    for i in range(1, ordering.SPLITS + 1):
        out.append(f"""p{i} AS (SELECT *, row_number() OVER w - 1 AS place, centre - lag(centre) OVER w AS gap, count(*) OVER (PARTITION BY doc_id, path) AS members FROM {last} WINDOW w AS (PARTITION BY doc_id, path ORDER BY centre, box_idx)),
q{i} AS (SELECT *, coalesce(max(gap) FILTER (gap > 0) OVER (PARTITION BY doc_id, path), 0) AS widest FROM p{i}),
r{i} AS (SELECT *, coalesce(min(place) FILTER (gap = widest AND gap > 0) OVER (PARTITION BY doc_id, path), -1) AS pl FROM q{i}),
k{i} AS (SELECT doc_id, box_idx, x0, y0, centre, CASE WHEN ok THEN path || CASE WHEN place < pl THEN '0' ELSE '1' END ELSE path END AS path, ok AS open
  FROM (SELECT *, open AND members >= 4 AND widest >= 0.2::DOUBLE AND pl >= 2 AND pl <= members - 2 AS ok FROM r{i}))""")
        last = f"k{i}"
    return ",\n".join(out) + f", col AS (SELECT doc_id, box_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, y0, x0, box_idx) - 1 AS INTEGER) AS column_rank FROM {last})"


@query("n01_column_major_order", sql("SELECT doc_id, box_idx, column_rank FROM col", _levels()))
def _(spark, sf):
    return ordering.column_major(boxes(docs(spark, sf))).select("doc_id", "box_idx", "column_rank")


def pages(spark, sf) -> DataFrame:
    """One row a page: line lengths, box areas, both reading orders. Every third line is lost and every fourth box extra."""
    held = boxes(docs(spark, sf))
    ranked = ordering.row_major(held).join(ordering.column_major(held).select("doc_id", "box_idx", "column_rank"), ["doc_id", "box_idx"])
    listed = lambda order, what: F.expr(f"transform(array_sort(collect_list(struct({order} as o, {what} as v))), x -> x.v)")
    sides = ranked.withColumn("area", G.capacity(F.col("box"))).groupBy("doc_id").agg(
        listed("box_idx", "area").alias("areas"), listed("row_rank", "box_idx").alias("by_row"), listed("column_rank", "box_idx").alias("by_column")
    )
    said = page_lines(spark, sf).groupBy("doc_id").agg(listed("line_idx", "length(text)").alias("lengths"))
    empty = F.array().cast("array<int>")
    return sides.join(said, "doc_id", "left").withColumn("lengths", F.coalesce("lengths", empty))


def page_lines(spark, sf) -> DataFrame:
    kept = lines(docs(spark, sf)).where("(doc_id + line_idx) % 3 <> 2")
    return kept.withColumn("line_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_idx")) - 1)


def _programme() -> str:
    """The dynamic programme by diagonals, each of which needs the two before it, and the way back."""
    return _levels() + f""",
pl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS i, text, length(text) AS len FROM v_lines WHERE (doc_id + line_idx) % 3 <> 2),
caps AS (SELECT b.doc_id, b.box_idx, greatest({G.MIN_AREA!r}::DOUBLE, (x1 - x0) * (y1 - y0)) AS cap, row_number() OVER (PARTITION BY b.doc_id ORDER BY y0, x0, b.box_idx) AS by_row, column_rank + 1 AS by_column
  FROM v_boxes b JOIN col c ON b.doc_id = c.doc_id AND b.box_idx = c.box_idx),
sides AS (SELECT doc_id, 0 AS o, by_row AS j, box_idx, cap FROM caps UNION ALL SELECT doc_id, 1, by_column, box_idx, cap FROM caps),
dims AS (SELECT doc_id, o, count(*) AS m, list_reduce(list_prepend(0::DOUBLE, list(cap ORDER BY j)), lambda a, b: a + b) AS total FROM sides GROUP BY doc_id, o),
sums AS (SELECT doc_id, count(*) AS n, CAST(greatest(1, sum(len)) AS DOUBLE) AS chars FROM pl GROUP BY doc_id),
dim AS (SELECT doc_id, o, m, n, total, chars FROM dims JOIN sums USING (doc_id)),
ex AS (SELECT doc_id, o, j, box_idx, greatest(1::DOUBLE, cap / total * chars) AS e FROM sides JOIN dim USING (doc_id, o)),
cells AS (
  SELECT doc_id, o, CAST(1 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(0 AS DOUBLE) AS cost, CAST(NULL AS INTEGER) AS op FROM dim
  UNION ALL SELECT doc_id, o, 1, 1, 0, {alignment.SKIP_LINE!r}, 1 FROM dim UNION ALL SELECT doc_id, o, 1, 0, 1, {alignment.SKIP_BOX!r}, 2 FROM dim
  UNION ALL
  SELECT * FROM (
    WITH w AS (SELECT c.*, d.m, d.n FROM cells c JOIN dim d USING (doc_id, o) WHERE c.cur < d.m + d.n),
    to_ AS (
      SELECT doc_id, o, cur, i, j + 1 AS j, cost + {alignment.SKIP_BOX!r}::DOUBLE AS cost, 2 AS op FROM w WHERE i + j = cur AND j < m
      UNION ALL SELECT doc_id, o, cur, i + 1, j, cost + {alignment.SKIP_LINE!r}::DOUBLE, 1 FROM w WHERE i + j = cur AND i < n
      UNION ALL SELECT w.doc_id, w.o, cur, w.i + 1, w.j + 1, cost + CASE WHEN greatest(1, l.len) > ex.e THEN (CAST(greatest(1, l.len) AS DOUBLE) - ex.e) / greatest(1, l.len) ELSE (ex.e - greatest(1, l.len)) / ex.e * 0.5::DOUBLE END, 0
      FROM w JOIN pl l ON l.doc_id = w.doc_id AND l.i = w.i + 1 JOIN ex ON ex.doc_id = w.doc_id AND ex.o = w.o AND ex.j = w.j + 1 WHERE w.i + w.j = cur - 1),
    best AS (SELECT doc_id, o, cur, i, j, min(struct_pack(cost := cost, op := op)) AS b FROM to_ GROUP BY ALL)
    SELECT doc_id, o, cur + 1, i, j, b.cost, CAST(b.op AS INTEGER) FROM best
    UNION ALL SELECT doc_id, o, cur + 1, i, j, cost, op FROM w WHERE i + j = cur)),
done AS (SELECT DISTINCT doc_id, o, i, j, cost, op FROM cells),
back AS (
  SELECT doc_id, o, n AS i, m AS j FROM dim
  UNION ALL
  SELECT b.doc_id, b.o, b.i - CASE WHEN op < 2 THEN 1 ELSE 0 END, b.j - CASE WHEN op <> 1 THEN 1 ELSE 0 END FROM back b JOIN done c USING (doc_id, o, i, j) WHERE b.i + b.j > 0),
steps AS (SELECT b.doc_id, b.o, b.i, b.j, op FROM back b JOIN done c USING (doc_id, o, i, j) WHERE b.i + b.j > 0),
ends AS (SELECT doc_id, o, cost FROM done JOIN dim USING (doc_id, o) WHERE i = n AND j = m),
costs AS (SELECT r.doc_id, r.cost AS cost_rows, c.cost AS cost_columns, CASE WHEN c.cost < r.cost THEN 1 ELSE 0 END AS o FROM ends r JOIN ends c ON r.doc_id = c.doc_id AND r.o = 0 AND c.o = 1),
pg AS (SELECT b.doc_id, CAST(coalesce(s.n, 0) AS INTEGER) AS n_lines, CAST(b.m AS INTEGER) AS n_boxes, coalesce(cost_rows, 0) AS cost_rows, coalesce(cost_columns, 0) AS cost_columns, coalesce(c.o, 0) AS o,
  CAST(coalesce(t.matches, 0) AS INTEGER) AS matches
  FROM (SELECT * FROM dims WHERE o = 0) b LEFT JOIN sums s USING (doc_id) LEFT JOIN costs c USING (doc_id) LEFT JOIN (SELECT doc_id, o, count(*) AS matches FROM steps WHERE op = 0 GROUP BY ALL) t ON t.doc_id = b.doc_id AND t.o = c.o),
page AS (SELECT *, coalesce((matches = 0 AND n_lines > 1) OR (n_lines = 1 AND n_boxes >= {alignment.MANY_BOXES}), false) AS whole FROM pg),
goes AS (SELECT doc_id, o, i, op, coalesce(last_value(CASE WHEN op = 0 THEN j END IGNORE NULLS) OVER (PARTITION BY doc_id, o ORDER BY i + j ROWS UNBOUNDED PRECEDING), 1) AS j FROM steps),
texts AS (SELECT g.doc_id, ex.box_idx, string_agg(pl.text, ' ' ORDER BY g.i) AS text FROM goes g JOIN page p ON p.doc_id = g.doc_id AND p.o = g.o JOIN ex ON ex.doc_id = g.doc_id AND ex.o = g.o AND ex.j = g.j JOIN pl ON pl.doc_id = g.doc_id AND pl.i = g.i WHERE g.op < 2 GROUP BY ALL)"""


@query("n02_dp_cost", sql(f"SELECT doc_id, n_lines, n_boxes, {SIX('cost_rows')} AS cost_rows, {SIX('cost_columns')} AS cost_columns, matches FROM page", _programme(), True))
def _(spark, sf):
    found = alignment.aligned_pages(pages(spark, sf))
    return found.select("doc_id", "n_lines", "n_boxes", six(F.col("cost_rows")).alias("cost_rows"), six(F.col("cost_columns")).alias("cost_columns"), "matches")


@query("a08_reading_order_choice", sql("SELECT doc_id, CASE WHEN o = 1 THEN 'columns' ELSE 'rows' END AS chosen, whole FROM page", _programme(), True))
def _(spark, sf):
    return alignment.aligned_pages(pages(spark, sf)).select("doc_id", "chosen", "whole")


@query("n04_align_text", sql("""SELECT b.doc_id, b.box_idx, coalesce(t.text, '') AS text FROM v_boxes b JOIN page p ON p.doc_id = b.doc_id AND NOT p.whole LEFT JOIN texts t ON t.doc_id = b.doc_id AND t.box_idx = b.box_idx
  UNION ALL SELECT p.doc_id, -1, string_agg(l.text, chr(10) ORDER BY l.i) FROM page p JOIN pl l USING (doc_id) WHERE p.whole GROUP BY p.doc_id""", _programme(), True))
def _(spark, sf):
    return alignment.aligned_text(page_lines(spark, sf), alignment.aligned_pages(pages(spark, sf)))


@query("a05_box_text_concat", sql("SELECT doc_id, line_idx // 3 AS box_idx, string_agg(text, ' ' ORDER BY line_idx) AS text FROM v_lines GROUP BY ALL"))
def _(spark, sf):
    to = F.floor(F.col("line_idx") / 3).cast("int").alias("box_idx")
    return lines(docs(spark, sf)).groupBy("doc_id", to).agg(F.expr("array_join(transform(array_sort(collect_list(struct(line_idx, text))), x -> x.text), ' ')").alias("text"))


# --- refine ------------------------------------------------------------------

REFINED = f"""told AS (SELECT doc_id, box_idx, (doc_id + box_idx) % 4 = 0 AS refined, CASE WHEN (doc_id + box_idx) % 4 = 0 AND box_idx > 0 THEN '  ' || replace(lag(text) OVER (PARTITION BY doc_id ORDER BY box_idx), ' ', '   ') ELSE text END AS text FROM v_boxes),
frm AS (SELECT *, {STRIP(f"regexp_replace(lower(text), '{SPACE}+', ' ', 'g')")} AS form FROM told)"""


def told(spark, sf) -> DataFrame:
    held = boxes(docs(spark, sf))
    again = (F.col("doc_id") + F.col("box_idx")) % 4 == 0
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("box_idx"))
    return held.withColumn("refined", again).withColumn("text", F.when(again & (F.col("box_idx") > 0), F.concat(F.lit("  "), F.replace(before, F.lit(" "), F.lit("   ")))).otherwise(F.col("text")))


@query("j07_refined_dedup", sql("""SELECT r.doc_id, r.box_idx, CASE WHEN r.refined AND r.form <> '' AND EXISTS (
  SELECT 1 FROM frm o WHERE o.doc_id = r.doc_id AND abs(o.box_idx - r.box_idx) <= 4 AND NOT o.refined AND o.text <> '' AND contains(o.form, r.form)) THEN '' ELSE r.text END AS text FROM frm r""", REFINED))
def _(spark, sf):
    return refine.without_duplicates(told(spark, sf)).select("doc_id", "box_idx", "text")


def blanked(spark, sf) -> DataFrame:
    return boxes(docs(spark, sf)).withColumn("text", F.when(F.col("box_idx") % 3 == 1, F.lit("  ")).otherwise(F.col("text")))


@query("f06_uncertain_boxes", sql("SELECT doc_id, box_idx FROM v_boxes WHERE box_idx % 3 = 1 AND x1 - x0 > 0.03::DOUBLE AND y1 - y0 > 0.008::DOUBLE"))
def _(spark, sf):
    return refine.uncertain(blanked(spark, sf)).select("doc_id", "box_idx")


@query("j09_refine_merge", sql("""SELECT doc_id, box_idx, CASE WHEN unsure AND box_idx % 2 = 0 THEN '' WHEN unsure THEN 'read ' || box_idx WHEN box_idx % 3 = 1 THEN '  ' ELSE text END AS text, unsure AS refined
  FROM (SELECT *, box_idx % 3 = 1 AND x1 - x0 > 0.03::DOUBLE AND y1 - y0 > 0.008::DOUBLE AS unsure FROM v_boxes)"""))
def _(spark, sf):
    held = blanked(spark, sf)
    read = refine.uncertain(held).select("doc_id", "box_idx", F.when(F.col("box_idx") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" read "), F.col("box_idx").cast("string"))).alias("text"))
    return refine.merged(held, read).select("doc_id", "box_idx", "text", "refined")


# --- parsers -----------------------------------------------------------------

PX = ", ".join(f"CAST(trunc({e} * {1700 if e[0] == 'x' else 2200}) AS INTEGER) AS {e}" for e in G.EDGES)
SAID = f"said AS (SELECT doc_id, box_idx, text, {PX} FROM v_boxes), good AS (SELECT * FROM said WHERE x1 > x0 AND y1 > y0)"
UNIT = ", ".join(f"{SIX(clamp_sql(e, '1700' if e[0] == 'x' else '2200'))} AS {e}" for e in G.EDGES)


def pixels(spark, sf) -> DataFrame:
    b = F.col("box")
    return boxes(docs(spark, sf)).select("doc_id", "box_idx", "text", *((b[e] * F.lit(1700 if e[0] == "x" else 2200)).cast("int").alias(e) for e in G.EDGES))


def in_order(item: Column, order: str = "box_idx") -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))


@query("t16_parse_freeform", sql(f"SELECT doc_id, box_idx AS block_idx, text, {UNIT} FROM good", SAID))
def _(spark, sf):
    """Answers are made from boxes, bare, fenced, after prose, in a wrapper or cut off, and must give them back."""
    corner = F.array("x0", "y0", "x1", "y1")
    item = F.struct(corner.alias("bbox_2d"), F.concat(F.lit(" "), "text").alias("content"))
    of = pixels(spark, sf).groupBy("doc_id").agg(F.to_json(F.transform(in_order(item), lambda x: x["i"])).alias("j"))
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.col("j")).when(k == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), "j"))
    raw = raw.when(k == 3, F.concat(F.lit('{"results": '), "j", F.lit("}"))).otherwise(F.concat(F.lit("```json "), "j"))
    return flat(responses.freeform_blocks(of.select("doc_id", raw.alias("raw"), F.lit(1700).alias("img_w"), F.lit(2200).alias("img_h")), ["doc_id"]))


LABELS = "CASE box_idx % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'image' WHEN 2 THEN NULL WHEN 3 THEN 'list_marker' ELSE 'text' END"
LABELLED = SAID + f"""{{}},
lab AS (SELECT *, {LABELS} AS label, CAST(box_idx % 3 AS INTEGER) AS page_index FROM said),
kept AS (SELECT * FROM lab WHERE coalesce(label, 'text') NOT IN ('image', 'empty_line', 'signature_line', 'list_marker')),
turned AS (SELECT doc_id, box_idx, text, label, page_index, CASE WHEN doc_id % 2 = 1 THEN y0 ELSE x0 END AS a, CASE WHEN doc_id % 2 = 1 THEN x0 ELSE y0 END AS b, CASE WHEN doc_id % 2 = 1 THEN y1 ELSE x1 END AS c, CASE WHEN doc_id % 2 = 1 THEN x1 ELSE y1 END AS d FROM kept),
votes AS (SELECT doc_id, count(*) FILTER (abs(c - a) > 0 AND abs(d - b) > 0 AND abs(d - b) > 1.5::DOUBLE * abs(c - a)) AS portrait, count(*) FILTER (abs(c - a) > 0 AND abs(d - b) > 0) AS counted FROM turned GROUP BY doc_id),
axes AS (SELECT doc_id, portrait > counted / 2 AS swap FROM votes),
read_ AS (SELECT doc_id, box_idx, text, coalesce(label, 'text') AS label, page_index, CASE WHEN swap THEN b ELSE a END AS x0, CASE WHEN swap THEN a ELSE b END AS y0, CASE WHEN swap THEN d ELSE c END AS x1, CASE WHEN swap THEN c ELSE d END AS y1 FROM turned JOIN axes USING (doc_id))""".replace("{}", "")


def hosted(spark, sf) -> DataFrame:
    """Provider answers over two pages of different size, with and without the envelope, odd documents with y first."""
    i = F.col("box_idx") % 6
    label = F.when(i == 0, "title").when(i == 1, "image").when(i == 2, F.lit(None)).when(i == 3, "list_marker").otherwise("text")
    odd = F.col("doc_id") % 2 == 1
    corner = F.when(odd, F.array("y0", "x0", "y1", "x1")).otherwise(F.array("x0", "y0", "x1", "y1"))
    item = F.struct(F.col("text").alias("block_content"), corner.alias("bbox"), F.col("box_idx").alias("block_id"), (F.col("box_idx") % 3).alias("page_index"), label.alias("block_label"), F.lit(1.0).alias("score"))
    sizes = F.array(F.struct(F.lit(1700).alias("width"), F.lit(2200).alias("height")), F.struct(F.lit(850).alias("width"), F.lit(1100).alias("height")))
    of = pixels(spark, sf).groupBy("doc_id").agg(F.transform(in_order(item), lambda x: x["i"]).alias("layout"))
    inner = of.select("doc_id", F.to_json(F.struct("layout", F.struct(sizes.alias("pages"), F.lit(2).alias("num_pages")).alias("data_info"))).alias("j"))
    return inner.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("j")).otherwise(F.concat(F.lit('{"code": 200, "data": '), "j", F.lit("}"))).alias("raw"))


def by_page(side: str, first: str, second: str) -> str:
    return SIX(f"greatest(0::DOUBLE, least(1::DOUBLE, {side} / CAST(CASE page_index WHEN 0 THEN {first} ELSE {second} END AS DOUBLE)))") + f" AS {side}"


@query("t14_parse_hosted", sql("SELECT doc_id, box_idx AS block_idx, page_index, text, label, " + ", ".join(by_page(e, "1700" if e[0] == "x" else "2200", "850" if e[0] == "x" else "1100") for e in G.EDGES) + " FROM read_ WHERE page_index < 2 AND text <> ''", LABELLED))
def _(spark, sf):
    return flat(responses.hosted_blocks(hosted(spark, sf), ["doc_id"]))


@query("t17_parse_ground_truth", sql("SELECT doc_id, box_idx AS block_idx, page_index, text, label, " + ", ".join(by_page(e, *("1700", "1700") if e[0] == "x" else ("2200", "2200")) for e in G.EDGES) + " FROM read_", LABELLED))
def _(spark, sf):
    return flat(responses.truth_blocks(hosted(spark, sf), ["doc_id"]))


@query("t15_parse_layout_details", sql(f"SELECT doc_id, box_idx AS block_idx, text, {UNIT} FROM said WHERE box_idx % 3 <> 1", SAID))
def _(spark, sf):
    """Flat lists, and lists by page, of blocks of which every third is an image."""
    label = F.when(F.col("box_idx") % 3 == 1, "image").otherwise("text")
    item = F.struct(label.alias("label"), F.col("text").alias("content"), F.array("x0", "y0", "x1", "y1").alias("bbox_2d"))
    of = pixels(spark, sf).groupBy("doc_id").agg(F.to_json(F.transform(in_order(item), lambda x: x["i"])).alias("j"))
    nested = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), "j", F.lit(", []]"))).otherwise(F.col("j"))
    head = F.lit('{"data_info": {"pages": [{"width": 1700, "height": 2200}]}, "layout_details": ')
    return flat(responses.detail_blocks(of.select("doc_id", F.concat(head, nested, F.lit("}")).alias("raw")), ["doc_id"]))


@query("k05_fixture_export", sql("""SELECT doc_id, '[' || string_agg('{"block_content":' || CAST(to_json(text) AS VARCHAR) || ',"bbox":[' || y0 || ',' || x0 || ',' || y1 || ',' || x1 || '],"block_id":' || k || ',"page_index":0,"block_label":"text","score":1.0}', ',' ORDER BY k) || ']' AS layout
FROM (SELECT doc_id, replace(text, '/', '|') AS text, """ + ", ".join(f"CAST(round_even({e} * {1700 if e[0] == 'x' else 2200}::DOUBLE, 0) AS INTEGER) AS {e}" for e in G.EDGES) + ", row_number() OVER (PARTITION BY doc_id ORDER BY box_idx) - 1 AS k FROM v_boxes) GROUP BY doc_id"))
def _(spark, sf):
    b = F.col("box")
    px = {e: G.rounded(b[e] * F.lit(1700.0 if e[0] == "x" else 2200.0)) for e in G.EDGES}
    item = F.struct(F.replace("text", F.lit("/"), F.lit("|")).alias("block_content"), F.array(px["y0"], px["x0"], px["y1"], px["x1"]).alias("bbox"), F.col("k").alias("block_id"), F.lit(0).alias("page_index"), F.lit("text").alias("block_label"), F.lit(1.0).alias("score"))
    numbered = boxes(docs(spark, sf)).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("box_idx")) - 1)
    return numbered.groupBy("doc_id").agg(F.to_json(F.transform(in_order(item, "k"), lambda x: x["i"])).alias("layout"))


# --- text layer --------------------------------------------------------------


def blocks_of(spark, sf) -> DataFrame:
    """Boxes with several lines each: three lines of a page go to the first one's box, as tall as all three."""
    held = boxes(docs(spark, sf))
    third = F.floor(F.col("box_idx") / 3).cast("int")
    b = held.groupBy("doc_id", third.alias("box_idx")).agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(box_idx, text))), x -> x.text), '\n')").alias("text"), F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1")
    )
    return b.select("doc_id", "box_idx", G.box(*(F.col(e) for e in G.EDGES)).alias("box"), "text")


BLOCKS = """blk AS (SELECT doc_id, box_idx // 3 AS box_idx, string_agg(text, chr(10) ORDER BY box_idx) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v_boxes GROUP BY ALL),
prt AS (SELECT *, string_split(text, chr(10)) AS ls FROM blk),
sl AS (SELECT doc_id, box_idx, x0, y0, x1, y1, len(ls) AS n, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS slice_idx, unnest(ls) AS text FROM prt),
slc AS (SELECT doc_id, box_idx, slice_idx, text, x0, x1, CASE WHEN n > 1 THEN y0 + slice_idx * ((y1 - y0) / n) ELSE y0 END AS y0, CASE WHEN n > 1 THEN y0 + (slice_idx + 1) * ((y1 - y0) / n) ELSE y1 END AS y1 FROM sl)"""


@query("g18_multiline_split", sql(f"SELECT doc_id, box_idx, slice_idx, text, {FLAT} FROM slc", BLOCKS))
def _(spark, sf):
    return flat(layer.line_slices(blocks_of(spark, sf)).drop("full_page"))


def _tall() -> str:
    """Tall boxes cut level by level."""
    out, last = ["t0 AS (SELECT doc_id, box_idx, text, x0, y0, x1, y1, '' AS path FROM v_boxes)"], "t0"
    for i in range(1, layer.LEVELS + 1):
        words = f"list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '')"
        out.append(f"""u{i} AS (SELECT *, {words} AS w FROM {last}),
s{i} AS (SELECT *, CASE WHEN y1 - y0 > 0.07::DOUBLE AND (y1 * 792::DOUBLE - y0 * 792::DOUBLE) / greatest(0.01::DOUBLE, x1 * 612::DOUBLE - x0 * 612::DOUBLE) > 0.2::DOUBLE AND len(w) >= 2
   THEN least(CASE WHEN y1 - y0 > 0.13::DOUBLE THEN 3 ELSE 2 END, len(w)) ELSE 1 END AS n FROM u{i}),
e{i} AS (SELECT *, unnest(range(n)) AS k FROM s{i}),
t{i} AS (SELECT doc_id, box_idx, CASE WHEN n > 1 THEN array_to_string(list_slice(w, CAST(round_even(k * len(w) / n, 0) AS BIGINT) + 1, CAST(round_even((k + 1) * len(w) / n, 0) AS BIGINT)), ' ') ELSE text END AS text,
   x0, CASE WHEN n > 1 THEN y0 + k * ((y1 - y0) / n) ELSE y0 END AS y0, x1, CASE WHEN n > 1 THEN y0 + (k + 1) * ((y1 - y0) / n) ELSE y1 END AS y1, path || k AS path FROM e{i})""")
        last = f"t{i}"
    return ",\n".join(out) + f", tall AS (SELECT * FROM {last} WHERE text <> '')"


def tall(spark, sf) -> DataFrame:
    held = boxes(docs(spark, sf)).select("doc_id", "box_idx", "box", "text", F.lit(False).alias("full_page"))
    return layer.tall_slices(held)


@query("g19_tall_box_split", sql(f"SELECT doc_id, box_idx, path, text, {FLAT} FROM tall", _tall()))
def _(spark, sf):
    return flat(tall(spark, sf).drop("full_page"))


@query("g14_layer_geometry", sql(f"""SELECT doc_id, box_idx, path, {SIX('x0 * 612::DOUBLE')} AS x, {SIX('y1 * 792::DOUBLE - 0.299::DOUBLE * fs')} AS baseline_y, {SIX('fs')} AS font_size, {SIX('greatest(1::DOUBLE, (x1 * 612::DOUBLE - x0 * 612::DOUBLE) * 0.98::DOUBLE)')} AS target_width
FROM (SELECT *, greatest(3::DOUBLE, least(72::DOUBLE, (y1 * 792::DOUBLE - y0 * 792::DOUBLE) / {G.ASCENDER - G.DESCENDER!r}::DOUBLE)) AS fs FROM tall) WHERE x1 * 612::DOUBLE - x0 * 612::DOUBLE > 0 AND y1 * 792::DOUBLE - y0 * 792::DOUBLE > 0""", _tall()))
def _(spark, sf):
    found = layer.drawn(tall(spark, sf))
    return found.select("doc_id", "box_idx", "path", *(six(F.col(c)).alias(c) for c in ("x", "baseline_y", "font_size", "target_width")))


@query("g17_full_page_lines", sql(f"SELECT doc_id, line_idx AS line, text, 10::DOUBLE AS x, {SIX('10::DOUBLE + 1.075::DOUBLE * 6 + line_idx * (1.075::DOUBLE + 0.299::DOUBLE) * 6')} AS baseline_y, 6::DOUBLE AS font_size, 592::DOUBLE AS target_width FROM v_lines WHERE n > 1"))
def _(spark, sf):
    """Pages that stand as a whole: their lines below each other, from the top."""
    whole = G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    page = line_arrays(docs(spark, sf)).where(F.size("lines") > 1).select("doc_id", F.lit(0).alias("box_idx"), whole.alias("box"), F.array_join("lines", "\n").alias("text"))
    found = layer.drawn(layer.tall_slices(layer.line_slices(page).drop("slice_idx")))
    return found.select("doc_id", "line", "text", *(six(F.col(c)).alias(c) for c in ("x", "baseline_y", "font_size", "target_width")))


@query("j03_page_left_layer", sql("SELECT d.doc_id, b.box_idx, b.text FROM documents d LEFT JOIN (SELECT * FROM v_boxes WHERE doc_id % 2 = 0) b USING (doc_id)"))
def _(spark, sf):
    found = docs(spark, sf)
    return found.select("doc_id").join(boxes(found).where("doc_id % 2 = 0").select("doc_id", "box_idx", "text"), "doc_id", "left")


@query("a04_page_text_rollup", sql("SELECT doc_id, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM v_lines GROUP BY doc_id"))
def _(spark, sf):
    return lines(docs(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.expr("array_join(transform(array_sort(collect_list(struct(line_idx, text))), x -> x.text), '\n')").alias("text"))


# --- checks ------------------------------------------------------------------

WORDS = """wds AS (SELECT doc_id, line_idx, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS k, unnest(w) AS word FROM (SELECT doc_id, line_idx, string_split(text, ' ') AS w FROM v_lines)),
wxy AS (SELECT doc_id, line_idx, k, word, 40::DOUBLE + 14.2::DOUBLE * line_idx + ((7 * k + doc_id) % 3) * 0.4::DOUBLE AS y, 30::DOUBLE + 20.5::DOUBLE * k AS x FROM wds)"""


def words(spark, sf) -> DataFrame:
    w = lines(docs(spark, sf)).select("doc_id", "line_idx", F.posexplode(F.split("text", " ")).alias("k", "word"))
    return w.withColumn("y", F.lit(40.0) + F.lit(14.2) * F.col("line_idx") + ((F.col("k") * 7 + F.col("doc_id")) % 3) * F.lit(0.4)).withColumn("x", F.lit(30.0) + F.lit(20.5) * F.col("k"))


@query("a16_visual_lines", sql(f"""SELECT doc_id, bucket, string_agg(word, ' ' ORDER BY x, line_idx, k) AS text, {SIX('min(x)')} AS x0, {SIX('max(x)')} AS x1, {SIX('arg_min(y, (x, line_idx, k))')} AS y
FROM (SELECT *, CAST(round_even(y / 5::DOUBLE, 0) AS BIGINT) * 5 AS bucket FROM wxy) GROUP BY doc_id, bucket""", WORDS))
def _(spark, sf):
    held = words(spark, sf).withColumn("bucket", F.bround(F.col("y") / 5.0).cast("bigint") * 5)
    order = F.struct("x", "line_idx", "k")
    text = F.expr("array_join(transform(array_sort(collect_list(struct(x, line_idx, k, word))), w -> w.word), ' ')")
    return held.groupBy("doc_id", "bucket").agg(text.alias("text"), six(F.min("x")).alias("x0"), six(F.max("x")).alias("x1"), six(F.min_by("y", order)).alias("y"))


@query("a15_spread_check", sql(f"SELECT doc_id, count(*) AS n_words, {SIX('min(y)')} AS y_min, {SIX('max(y)')} AS y_max, max(y) - min(y) < 10 AS narrow FROM wxy GROUP BY doc_id", WORDS))
def _(spark, sf):
    return words(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), six(F.min("y")).alias("y_min"), six(F.max("y")).alias("y_max"), (F.max("y") - F.min("y") < 10).alias("narrow"))


@query("f10_keyword_check", sql("SELECT doc_id, list_bool_or([contains(lower(text), 'license'), contains(lower(text), 'token'), contains(lower(text), 'the ')]) AS found FROM documents"))
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.exists(F.array(*map(F.lit, ("License", "TOKEN", "the "))), lambda k: F.contains(F.lower("text"), F.lower(k))).alias("found"))


@query("a17_fill_rate", sql(f"SELECT doc_id, {SIX('count(*) FILTER (box_idx % 3 <> 1) / count(*)')} AS fill_rate FROM v_boxes GROUP BY doc_id"))
def _(spark, sf):
    return blanked(spark, sf).groupBy("doc_id").agg(six(F.count_if(X.strip(F.col("text")) != "") / F.count(F.lit(1))).alias("fill_rate"))


@query("a18_conservation", sql("SELECT l.doc_id, bool_and(contains(t.text, l.text)) AS kept FROM v_lines l JOIN (SELECT doc_id, string_agg(text, ' ' ORDER BY line_idx) AS text FROM v_lines WHERE NOT (doc_id % 5 = 0 AND line_idx = 2) GROUP BY doc_id) t USING (doc_id) GROUP BY l.doc_id"))
def _(spark, sf):
    said = lines(docs(spark, sf))
    out = said.where("not (doc_id % 5 = 0 and line_idx = 2)").groupBy("doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(line_idx, text))), x -> x.text), ' ')").alias("whole"))
    return said.join(out, "doc_id").groupBy("doc_id").agg(F.bool_and(F.contains("whole", F.col("text"))).alias("kept"))


@query("a19_dup_line_check", sql("SELECT doc_id, line_idx, text FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_idx) AS before FROM v_lines) WHERE text = before AND length(text) > 5"))
def _(spark, sf):
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("line_idx"))
    return lines(docs(spark, sf)).withColumn("before", before).where("text = before and length(text) > 5").drop("before")


@query("f12_order_check", sql("SELECT doc_id, bool_and(x0 BETWEEN 0 AND 1 AND y0 BETWEEN 0 AND 1 AND x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1) AS inside, bool_and(coalesce(y0 >= before, true)) AS rising FROM (SELECT *, lag(y0) OVER (PARTITION BY doc_id ORDER BY box_idx) AS before FROM v_boxes) GROUP BY doc_id"))
def _(spark, sf):
    held = boxes(docs(spark, sf)).withColumn("before", F.lag("box.y0").over(Window.partitionBy("doc_id").orderBy("box_idx")))
    inside = F.lit(True)
    for e in G.EDGES:
        inside = inside & F.col("box")[e].between(0, 1)
    return held.groupBy("doc_id").agg(F.bool_and(inside).alias("inside"), F.bool_and(F.coalesce(F.col("box.y0") >= F.col("before"), F.lit(True))).alias("rising"))


# --- progress ----------------------------------------------------------------

STAGE = "CASE event_type " + "{}" + " END"


@query("p01_progress_percent", """SELECT event_id, stage, CAST(CASE WHEN total <= 0 THEN lo ELSE lo + trunc(current / total * (hi - lo)) END AS INTEGER) AS percent FROM (
  SELECT event_id, current, total, stage, CASE stage WHEN 'convert' THEN 0 WHEN 'detect' THEN 15 WHEN 'ocr' THEN 25 WHEN 'refine' THEN 75 WHEN 'embed' THEN 90 ELSE 0 END AS lo, CASE stage WHEN 'convert' THEN 15 WHEN 'detect' THEN 25 WHEN 'ocr' THEN 75 WHEN 'refine' THEN 90 ELSE 100 END AS hi
  FROM (SELECT event_id, event_id % 21 AS current, CASE WHEN event_id % 50 = 0 THEN 0 ELSE 20 END AS total, ['convert', 'detect', 'ocr', 'refine', 'embed', 'other'][1 + event_id % 6] AS stage FROM events))""")
def _(spark, sf):
    from quire.streaming.progress import percent

    e = F.col("event_id")
    stage = F.element_at(F.array(*map(F.lit, ("convert", "detect", "ocr", "refine", "embed", "other"))), (e % 6 + 1).cast("int"))
    held = table(spark, sf, "events").select("event_id", (e % 21).alias("current"), F.when(e % 50 == 0, 0).otherwise(20).alias("total"), stage.alias("stage"))
    return held.select("event_id", "stage", percent(F.col("stage"), F.col("current"), F.col("total")).alias("percent"))


@query("p02_stage_presence", sql("SELECT doc_id, CASE WHEN count(*) FILTER (box_idx % 3 = 1 AND x1 - x0 > 0.03::DOUBLE AND y1 - y0 > 0.008::DOUBLE) > 0 THEN 'convert,detect,ocr,refine,embed' ELSE 'convert,detect,ocr,embed' END AS stages FROM v_boxes GROUP BY doc_id"))
def _(spark, sf):
    unsure = F.count_if((X.strip(F.col("text")) == "") & G.refinable(F.col("box"))) > 0
    return blanked(spark, sf).groupBy("doc_id").agg(F.when(unsure, "convert,detect,ocr,refine,embed").otherwise("convert,detect,ocr,embed").alias("stages"))


@query("t07_text_similarity")
def _(spark, sf):
    from quire.operators.similarity import similar

    found, truth, predicted = matched(spark, sf)
    pairs = found.where("pred_idx is not null").join(truth.select("doc_id", F.col("box_idx").alias("gt_idx"), F.col("text").alias("gt_text")), ["doc_id", "gt_idx"])
    pairs = pairs.join(predicted.select("doc_id", F.col("box_idx").alias("pred_idx"), F.col("text").alias("pred_text")), ["doc_id", "pred_idx"])
    return pairs.select("doc_id", "gt_idx", "pred_idx", similar(F.col("gt_text"), F.col("pred_text")).alias("similarity"))


# --- reports, labels and the rest ------------------------------------------------


@query("t18_data_url", "SELECT page_id, 'data:image/jpeg;base64,' || base64(encode(url)) AS url FROM pages")
def _(spark, sf):
    from quire.sources.models import data_url

    return table(spark, sf, "pages").select("page_id", data_url(F.encode("url", "utf-8")).alias("url"))


TWO = lambda x: f"floor(({x}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE"


@query("t20_summary_line", sql(f"""SELECT doc_id, printf('%-20s gt=%-3d pipeline=%-3d matched=%-3d recall=%.2f iou_avg=%.2f', 'doc' || doc_id, gt_count, coalesce(pipeline_count, 0), matched, {TWO('CAST(matched AS DOUBLE) / greatest(1, gt_count)')}, {TWO('total / greatest(1, matched)')}) AS line
FROM (SELECT doc_id, count(*) AS gt_count, count(*) FILTER (iou >= 0.3::DOUBLE) AS matched, coalesce(list_reduce(list_prepend(0::DOUBLE, list(iou ORDER BY gt_idx) FILTER (iou >= 0.3::DOUBLE)), lambda a, b: a + b), 0::DOUBLE) AS total FROM matches GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS pipeline_count FROM v_pred GROUP BY doc_id) USING (doc_id)""", GREEDY, True))
def _(spark, sf):
    found, _, predicted = matched(spark, sf)
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return matching.report(found, predicted).select("doc_id", matching.summary_line(name).alias("line"))


@query("t23_progress_label", sql("SELECT doc_id % 50 AS job, CASE WHEN count(*) FILTER (dense) > 0 THEN 'OCR (' || count(*) FILTER (dense) || ' dense / ' || count(*) FILTER (NOT dense) || ' sparse)' ELSE 'OCR' END AS label FROM (SELECT doc_id, count(*) > 60 AS dense FROM v_boxes GROUP BY doc_id) GROUP BY doc_id % 50"))
def _(spark, sf):
    from quire.streaming.progress import reading_label

    pages = refine.dense_pages(boxes(docs(spark, sf)))
    return pages.groupBy((F.col("doc_id") % 50).alias("job")).agg(reading_label(F.count_if("dense"), F.count_if(~F.col("dense"))).alias("label"))


@query("a01_boxes_per_page", sql(f"SELECT doc_id, count(*) AS n_boxes, greatest(1, CAST(sum(length(text)) AS BIGINT)) AS chars, {SIX('list_reduce(list(greatest(1e-6::DOUBLE, (x1 - x0) * (y1 - y0)) ORDER BY box_idx), lambda a, b: a + b)')} AS capacity FROM v_boxes GROUP BY doc_id"))
def _(spark, sf):
    held = boxes(docs(spark, sf)).withColumn("cap", G.capacity(F.col("box")))
    total = F.expr("aggregate(array_sort(collect_list(struct(box_idx, cap))), 0D, (a, x) -> a + x.cap)")
    return held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_boxes"), F.greatest(F.lit(1), F.sum(F.length("text"))).cast("bigint").alias("chars"), six(total).alias("capacity"))


PATHS = GREEDY + f""",
bare AS (SELECT b.doc_id, b.box_idx, max(i.iou) AS iou FROM v_boxes b LEFT JOIN ious i ON i.doc_id = b.doc_id AND i.gt_idx = b.box_idx GROUP BY ALL)"""


@query("a13_report_table", sql(f"""SELECT document, path, count(*) AS gt, count(*) FILTER (iou >= 0.3::DOUBLE) AS matched, {SIX('count(*) FILTER (iou >= 0.3::DOUBLE) / greatest(1, count(*))')} AS recall FROM (
  SELECT doc_id % 20 AS document, 'hybrid' AS path, iou FROM matches UNION ALL SELECT doc_id % 20, 'grounded', coalesce(iou, 0) FROM bare) GROUP BY document, path""", PATHS, True))
def _(spark, sf):
    """One row for each document and path; the grounded path here lets boxes be taken again."""
    found, truth, predicted = matched(spark, sf)
    pairs = matching.meeting_pairs(truth.select("doc_id", "box_idx", "box"), predicted.select("doc_id", "box_idx", "box"))
    best = pairs.groupBy("doc_id", F.col("l.box_idx").alias("box_idx")).agg(F.max(G.iou(F.col("l.box"), F.col("r.box"))).alias("iou"))
    free = truth.select("doc_id", "box_idx").join(best, ["doc_id", "box_idx"], "left").select("doc_id", F.lit("grounded").alias("path"), F.coalesce("iou", F.lit(0.0)).alias("iou"))
    both = found.select("doc_id", F.lit("hybrid").alias("path"), "iou").unionByName(free)
    hit = F.count_if(F.col("iou") >= matching.THRESHOLD)
    return both.groupBy((F.col("doc_id") % 20).alias("document"), "path").agg(F.count(F.lit(1)).alias("gt"), hit.alias("matched"), six(hit / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("recall"))


@query("a11_avg_text_similarity")
def _(spark, sf):
    """Mean similarity of matched texts for each document; 0 where nothing matched."""
    from quire.operators.similarity import similar

    found, truth, predicted = matched(spark, sf)
    said = found.join(truth.select("doc_id", F.col("box_idx").alias("gt_idx"), F.col("text").alias("x")), ["doc_id", "gt_idx"])
    said = said.join(predicted.select("doc_id", F.col("box_idx").alias("pred_idx"), F.col("text").alias("y")), ["doc_id", "pred_idx"], "left")
    alike = F.when(F.col("pred_idx").isNotNull(), similar(F.col("x"), F.col("y")))
    # in order, so that the sum is the same each time
    held = F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("gt_idx", "s"))))
    total = F.expr("aggregate(held, 0D, (a, x) -> a + x.s) / greatest(1, size(held))")
    return said.select("doc_id", "gt_idx", alike.alias("s")).groupBy("doc_id").agg(held.alias("held")).select("doc_id", total.alias("similarity"))


@query("a20_blank_deviation", f"SELECT vec_id, {SIX('stddev_pop(v)')} AS deviation, stddev_pop(v) < 12 AS blank FROM (SELECT vec_id, CAST(floor(128 + 100 * CAST(unnest(embedding) AS DOUBLE)) AS INTEGER) AS v FROM embeddings) GROUP BY vec_id")
def _(spark, sf):
    from quire.sources.models import BLANK_DEVIATION

    gray = table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("x")).select("vec_id", F.floor(F.col("x").cast("double") * 100 + 128).cast("int").alias("v"))
    return gray.groupBy("vec_id").agg(six(F.stddev_pop("v")).alias("deviation"), (F.stddev_pop("v") < BLANK_DEVIATION).alias("blank"))


@query("w06_completion_counter", "SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS completed, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, sf):
    w = Window.partitionBy("user_id")
    return table(spark, sf, "events").select("event_id", "user_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("completed"), F.count(F.lit(1)).over(w).alias("total"))


@query("w08_first_box_per_tag", sql("SELECT doc_id, tag, first, coalesce(first >= lag(first) OVER (PARTITION BY doc_id ORDER BY tag), true) AS rising FROM (SELECT doc_id, text AS tag, min(box_idx) AS first FROM v_boxes GROUP BY ALL)"))
def _(spark, sf):
    first = boxes(docs(spark, sf)).groupBy("doc_id", F.col("text").alias("tag")).agg(F.min("box_idx").alias("first"))
    before = F.lag("first").over(Window.partitionBy("doc_id").orderBy("tag"))
    return first.withColumn("rising", F.coalesce(F.col("first") >= before, F.lit(True)))


@query("o06_head_and_tail", sql("SELECT doc_id, line_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx DESC) AS b FROM v_lines) WHERE a <= 10 OR b <= 5"))
def _(spark, sf):
    w = Window.partitionBy("doc_id")
    held = lines(docs(spark, sf)).withColumn("a", F.row_number().over(w.orderBy("line_idx"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("line_idx"))))
    return held.where("a <= 10 or b <= 5").select("doc_id", "line_idx", "text")


@query("u01_page_strategies", sql("SELECT doc_id, box_idx, text, CASE WHEN n > 60 THEN 'box by box' ELSE 'page' END AS read FROM v_boxes"))
def _(spark, sf):
    """Dense pages one way, sparse pages another, and their union."""
    held = boxes(docs(spark, sf)).select("doc_id", "box_idx", "text")
    dense = refine.dense_pages(boxes(docs(spark, sf))).where("dense").select("doc_id")
    one = held.join(dense, "doc_id", "left_semi").withColumn("read", F.lit("box by box"))
    return one.unionByName(held.join(dense, "doc_id", "left_anti").withColumn("read", F.lit("page")))


@query("u06_lost_lines", sql("SELECT doc_id, text FROM v_lines EXCEPT SELECT doc_id, text FROM v_lines WHERE (doc_id + line_idx) % 3 <> 2"))
def _(spark, sf):
    return lines(docs(spark, sf)).select("doc_id", "text").subtract(page_lines(spark, sf).select("doc_id", "text"))


@query("j02_page_boxes", sql(f"SELECT d.doc_id, d.lang, b.box_idx, {FLAT} FROM documents d JOIN v_boxes b USING (doc_id)"))
def _(spark, sf):
    found = table(spark, sf, "documents")
    return flat(found.select("doc_id", "lang").join(boxes(found).select("doc_id", "box_idx", "box"), "doc_id"))


@query("k07_job_texts", "SELECT conv_id, '{' || string_agg('\"' || turn || '\":[' || CAST(to_json(t) AS VARCHAR) || ']', ',' ORDER BY turn) || '}' AS text FROM (SELECT conv_id, turn, string_agg(replace(text, '/', '|'), ' ' ORDER BY text) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def _(spark, sf):
    from quire.sources.sinks import job_texts

    said = table(spark, sf, "conversations").groupBy("conv_id", F.col("turn").alias("page_index")).agg(F.array_join(F.array_sort(F.collect_list(F.replace("text", F.lit("/"), F.lit("|")))), " ").alias("text"))
    return job_texts(said.withColumn("line_idx", F.lit(0)), "conv_id")


@query("k09_draw_commands", sql("SELECT doc_id, box_idx, " + ", ".join(f"CAST(trunc({e} * {1275 if e[0] == 'x' else 1650}) AS INTEGER) AS {e}" for e in G.EDGES) + ", CASE WHEN x1 - x0 > 0.03::DOUBLE AND y1 - y0 > 0.008::DOUBLE THEN 'green' ELSE 'red' END AS colour FROM v_boxes"))
def _(spark, sf):
    from quire.sources.sinks import draw_commands

    return draw_commands(boxes(docs(spark, sf)), 1275, 1650)

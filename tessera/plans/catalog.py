"""Every operator as a query over the test tables, with its SQL. Scores are rounded to four decimals on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scores import four_decimals
from tessera.functions.values import DocField, Field
from tessera.operators import feedback, graph, retrieve, temporal
from tessera.operators.graph import Step
from tessera.operators.retrieve import Order
from tessera.operators.text_index import TextIndex
from tessera.sources import bindings as b
from tessera.sources.log import MutationLog
from tessera.stored import new_folder, stored
from tessera.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Fixed query vector: the pattern of cosines is arbitrary, its length that of the test embeddings.
VECTOR = [round(((i * 37) % 64) / 32 - 1, 4) for i in range(64)]
_V = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_V})"
TEXT = "the of license"
_r4 = lambda c: F.round(F.col(c).cast("double"), 4)
_score = lambda df, *cols: df.select(*cols, _r4("score").alias("score"))


# ---- scans, projections, filters ----
_DOC = "SELECT doc_id AS id, lang, source, n_chars FROM documents"


def _docs(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    d = b.doc(spark, sf_dir)
    return (d if where is None else d.where(where(d))).select("id", "lang", "source", "n_chars")


@query("SELECT doc_id AS id, text, lang, source, n_chars, doc_id + 1 AS created_at FROM documents")
def scan_all(spark, sf_dir):
    return b.doc(spark, sf_dir)


@query("SELECT doc_id AS id, lang, n_chars FROM documents")
def project_fields(spark, sf_dir):
    return b.doc(spark, sf_dir).select("id", "lang", "n_chars")


@query("SELECT count(*) AS count FROM documents")
def count_star(spark, sf_dir):
    return retrieve.count_rows(b.doc(spark, sf_dir))


@query("SELECT count(*) AS count FROM documents WHERE lang = 'en' AND n_chars > 1000")
def count_filtered(spark, sf_dir):
    d = b.doc(spark, sf_dir)
    return retrieve.count_rows(d.where(retrieve.field(d, "lang").eq("en") & retrieve.field(d, "n_chars").compare(">", 1000)))


@query(f"{_DOC} WHERE lang = 'de'")
def filter_eq(spark, sf_dir):
    return _docs(spark, sf_dir, lambda d: retrieve.field(d, "lang").eq("de"))


@query(f"{_DOC} WHERE lang <> 'en'")
def filter_ne(spark, sf_dir):
    return _docs(spark, sf_dir, lambda d: retrieve.field(d, "lang").compare("!=", "en"))


@query(f"{_DOC} WHERE n_chars < 500 OR n_chars <= 300")
def filter_lt_le(spark, sf_dir):
    n = lambda d: retrieve.field(d, "n_chars")
    return _docs(spark, sf_dir, lambda d: n(d).compare("<", 500) | n(d).compare("<=", 300))


@query(f"{_DOC} WHERE n_chars > 2000.5 AND n_chars >= 2500")
def filter_gt_ge(spark, sf_dir):
    n = lambda d: retrieve.field(d, "n_chars")
    return _docs(spark, sf_dir, lambda d: n(d).compare(">", 2000.5) & n(d).compare(">=", 2500))


@query(f"{_DOC} WHERE lang IN ('fr', 'es')")
def filter_in(spark, sf_dir):
    return _docs(spark, sf_dir, lambda d: retrieve.field(d, "lang").is_in(["fr", "es", 3]))


@query(f"{_DOC} WHERE n_chars BETWEEN 600 AND 900")
def filter_between(spark, sf_dir):
    return _docs(spark, sf_dir, lambda d: retrieve.field(d, "n_chars").between(600, 900))


@query(f"{_DOC} WHERE lang = 'en' AND source = 'src3' AND n_chars < 1500")
def filter_and(spark, sf_dir):
    return _docs(spark, sf_dir, lambda d: retrieve.field(d, "lang").eq("en") & retrieve.field(d, "source").eq("src3") & retrieve.field(d, "n_chars").compare("<", 1500))


@query("SELECT vec_id AS id, label FROM embeddings WHERE embedding IS NOT NULL")
def filter_has_embedding(spark, sf_dir):
    return retrieve.has_embedding(b.vec(spark, sf_dir)).select("id", "label")


@query(f"{_DOC} WHERE 'doc:' || doc_id = 'doc:7'")
def filter_id_eq(spark, sf_dir):
    return retrieve.id_in(b.doc(spark, sf_dir), "doc", ["doc:7"]).select("id", "lang", "source", "n_chars")


@query(f"{_DOC} WHERE 'doc:' || doc_id IN ('doc:1', 'doc:5', 'vec:9', 'doc:007')")
def filter_id_in(spark, sf_dir):
    return retrieve.id_in(b.doc(spark, sf_dir), "doc", ["doc:1", "doc:5", "vec:9", "doc:007", "doc:99999999999999999999"]).select("id", "lang", "source", "n_chars")


@query(f"{_DOC} WHERE 'doc:' || doc_id <> 'doc:7'")
def filter_id_ne(spark, sf_dir):
    return retrieve.id_not(b.doc(spark, sf_dir), "doc", "doc:7").select("id", "lang", "source", "n_chars")


@query(f"{_DOC} WHERE n_chars IS NOT NULL AND lang IS NOT NULL AND n_chars > 1500")
def filter_cross_type(spark, sf_dir):
    """A number is below any string, a string above any number; a float literal compares with ints exactly."""
    f = retrieve.field
    return _docs(spark, sf_dir, lambda d: f(d, "n_chars").compare("<", "a") & f(d, "lang").compare(">", 10**6) & f(d, "n_chars").compare(">", 1500.25 - 0.25) & f(d, "n_chars").compare("!=", None))


# ---- orders and pages ----
@query("SELECT doc_id AS id, lang FROM documents ORDER BY lang, doc_id LIMIT 50")
def order_field_asc(spark, sf_dir):
    return retrieve.order_by_field(b.doc(spark, sf_dir), "lang", limit=50).select("id", "lang")


@query("SELECT doc_id AS id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def order_field_desc(spark, sf_dir):
    return retrieve.order_by_field(b.doc(spark, sf_dir), "n_chars", descending=True, limit=50).select("id", "n_chars")


@query("SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 30")
def offset_limit(spark, sf_dir):
    return retrieve.page(b.doc(spark, sf_dir), [F.col("id").asc()], 30, 20).select("id")


@query("SELECT doc_id AS id, doc_id + 1 AS created_at FROM documents ORDER BY created_at DESC, id LIMIT 25")
def order_recency(spark, sf_dir):
    return retrieve.recency(b.doc(spark, sf_dir), limit=25).select("id", "created_at")


# ---- vectors and text ----
@query(f"SELECT vec_id AS id, label, round({_COS}, 4) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    return _score(retrieve.knn(b.vec(spark, sf_dir), VECTOR, 10), "id", "label")


@query(f"SELECT vec_id AS id, round({_COS}, 4) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 5 OFFSET 3")
def knn_limit_offset(spark, sf_dir):
    return _score(retrieve.knn(b.vec(spark, sf_dir), VECTOR, 10, offset=3, limit=5), "id")


@query(f"SELECT vec_id AS id, round({_COS}, 4) AS score FROM embeddings ORDER BY vec_id DESC LIMIT 5")
def knn_order_recency(spark, sf_dir):
    """A structural order wins over similarity, and k caps after it."""
    return _score(retrieve.select(b.vec(spark, sf_dir), near=(VECTOR, 5), order=Order("recency")), "id")


def _bm25_sql(terms: list[str], tail: str, extra: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda t: t <> '') AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, greatest(1.0, sum(len(t)) / count(*)) AS avgdl FROM tok),
hit AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, unnest(t) AS term, len(t) AS dl FROM tok) WHERE term IN ({listed}) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
sc AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM hit JOIN df USING (term), st GROUP BY id),
lex AS (SELECT doc_id AS id, coalesce(s, 0.0) AS score FROM documents d LEFT JOIN sc ON sc.id = d.doc_id){extra}
{tail}"""


@query(_bm25_sql(["the", "of", "license"], "SELECT id, round(score, 4) AS score FROM lex ORDER BY lex.score DESC, id LIMIT 10"))
def bm25_topk(spark, sf_dir):
    return _score(retrieve.lexical(b.doc(spark, sf_dir), "text", TEXT, 10), "id")


@query(_bm25_sql(["the", "of", "license"], "SELECT id, round(score, 4) AS score FROM lex ORDER BY lex.score DESC, id LIMIT 10 OFFSET 2"))
def bm25_from_index(spark, sf_dir):
    """From a stored index; the second query of it reads no text."""
    path = new_folder(spark, "index")
    TextIndex.of(b.doc(spark, sf_dir), "text", path, version=1)
    return _score(TextIndex.of(b.doc(spark, sf_dir), "text", path, version=1).top(TEXT, 10, offset=2), "id")


@query(_bm25_sql(["license", "mit"], "SELECT id, round(score, 4) AS score FROM lex ORDER BY lex.score DESC, id LIMIT 10"))
def bm25_duplicate_terms(spark, sf_dir):
    return _score(retrieve.lexical(b.doc(spark, sf_dir), "text", "License MIT license LICENSE", 10), "id")


@query(_bm25_sql(["license"], "SELECT id, round(score, 4) AS score FROM lex"))
def bm25_zero_rows(spark, sf_dir):
    """Rows without a match stay, with 0."""
    return _score(retrieve.lexical_scores(b.doc(spark, sf_dir), "text", "license", ["id"]), "id")


_HYBRID = f""",
sem AS (SELECT vec_id AS id, {_COS} AS c FROM embeddings),
al AS (SELECT l.id, l.score AS lexical, coalesce(c, 0.0) AS semantic FROM lex l LEFT JOIN sem USING (id)),
rk AS (SELECT id, row_number() OVER (ORDER BY lexical DESC, id) AS rank_lex, row_number() OVER (ORDER BY semantic DESC, id) AS rank_vec FROM al)"""


@query(_bm25_sql(["the", "of", "license"], "SELECT id, rank_lex, rank_vec, round(1.0 / (60 + rank_lex) + 1.0 / (60 + rank_vec), 4) AS score FROM rk ORDER BY 1.0 / (60 + rank_lex) + 1.0 / (60 + rank_vec) DESC, id LIMIT 15", _HYBRID))
def hybrid_rrf(spark, sf_dir):
    both = b.doc(spark, sf_dir).join(b.vec(spark, sf_dir).select("id", "embedding"), "id", "left")
    return _score(retrieve.hybrid(both, "text", TEXT, VECTOR, 15), "id", "rank_lex", "rank_vec")


@query(f"SELECT vec_id AS id, printf('%.4f', {_COS}) AS score FROM embeddings")
def score_as_text(spark, sf_dir):
    """Scores as they are shown."""
    return retrieve.similarity(b.vec(spark, sf_dir), VECTOR).select("id", four_decimals(F.col("score")).alias("score"))


# ---- votes, feedback, salience ----
_VOTE = "SELECT doc_id AS dst, CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END AS value, CASE WHEN toxic = 1 THEN 0.5 END AS weight, doc_id + 1 AS created_at FROM labels"
_LAPLACE = f"v AS ({_VOTE}), p AS (SELECT dst, sum(coalesce(weight, value, 1.0)) AS w, count(*) AS n FROM v GROUP BY dst), s AS (SELECT d.*, (coalesce(w, 0) + 1) / (coalesce(n, 0) + 2)::DOUBLE AS ls FROM documents d LEFT JOIN p ON p.dst = d.doc_id)"


@query(f"WITH {_LAPLACE} SELECT doc_id AS id, round(ls::DOUBLE, 4) AS score FROM s")
def score_votes_laplace(spark, sf_dir):
    return _score(feedback.laplace_score(b.doc(spark, sf_dir), b.votes(spark, sf_dir)), "id")


@query(f"WITH v AS ({_VOTE}) SELECT doc_id AS id, coalesce(sum(value), 0)::DOUBLE AS score FROM documents LEFT JOIN v ON dst = doc_id GROUP BY doc_id")
def net_votes(spark, sf_dir):
    return _score(feedback.net_votes(b.doc(spark, sf_dir), b.votes(spark, sf_dir)), "id")


@query(f"WITH v AS ({_VOTE}), m AS (SELECT max(created_at) AS t FROM v) SELECT doc_id AS id, round(coalesce(sum(value::DOUBLE / (1 + t - created_at)), 0.0), 4) AS score FROM documents LEFT JOIN (v CROSS JOIN m) ON dst = doc_id GROUP BY doc_id")
def feedback_decay(spark, sf_dir):
    return _score(feedback.decayed_feedback(b.doc(spark, sf_dir), b.votes(spark, sf_dir)), "id")


@query(f"WITH {_LAPLACE} SELECT e.vec_id AS id, round(0.7 * {_COS} + 0.3 * greatest(0.0, least(1.0, ls::DOUBLE)), 4) AS score FROM embeddings e JOIN s ON s.doc_id = e.vec_id")
def salience_default(spark, sf_dir):
    v = retrieve.similarity(b.vec(spark, sf_dir), VECTOR, score="similarity").join(b.doc(spark, sf_dir).select("id"), "id", "left_semi")
    return _score(feedback.salience(v, b.votes(spark, sf_dir)), "id")


@query(f"""WITH {_LAPLACE}, c AS (SELECT max(doc_id) + 1 AS clock FROM documents)
SELECT doc_id AS id, round(0.5 * (0.5 / (1 + clock - (doc_id + 1)) + 0.5 * coalesce(n, 0) / (coalesce(n, 0) + 1)::DOUBLE) + 0.3 * least(1.0, greatest(0.0, n_chars / 5000.0))::DOUBLE + 0.2 * greatest(0.0, least(1.0, ls::DOUBLE)), 4) AS score
FROM s LEFT JOIN p ON p.dst = s.doc_id CROSS JOIN c""")
def salience_weighted(spark, sf_dir):
    d = b.doc(spark, sf_dir).withColumn("importance", F.col("n_chars") / 5000.0)
    clock = d.agg(F.max("created_at")).first()[0] or 0
    votes = b.votes(spark, sf_dir)
    return _score(feedback.salience(d, votes, (0.1, 0.5, 0.3, 0.2), votes.select(F.col("dst").alias("id")), clock), "id")


# ---- every mode under every order ----
_ORDERS: dict[str, Order | None] = {
    "none": None, "field": Order("field", "n_chars"), "field_desc": Order("field", "lang", descending=True), "recency": Order("recency"), "similarity": Order("similarity"),
    "score": Order("score"), "votes": Order("votes"), "feedback": Order("feedback"), "salience": Order("salience"), "salience_weighted": Order("salience", weights=(0.4, 0.3, 0.2, 0.1)),
}
_MODES = ("scan", "knn", "bm25", "hybrid")
_MODE_SQL = f"""{_HYBRID.replace(", row_number() OVER (ORDER BY lexical DESC", ", lexical, semantic, row_number() OVER (ORDER BY lexical DESC")},
v AS ({{vote}}), m AS (SELECT max(created_at) AS t FROM v), clk AS (SELECT max(doc_id) + 1 AS clock FROM documents),
p AS (SELECT dst, sum(coalesce(weight, value, 1.0))::DOUBLE AS w, count(*) AS n, sum(value)::DOUBLE AS net, sum(value::DOUBLE / (1 + t - created_at)) AS fb FROM v, m GROUP BY dst),
al2 AS (SELECT d.doc_id AS id, d.n_chars, d.lang, d.doc_id + 1 AS created_at, lexical, semantic, 1.0::DOUBLE / (60 + rank_lex) + 1.0::DOUBLE / (60 + rank_vec) AS fused,
  greatest(0.0, least(1.0, (coalesce(w, 0) + 1) / (coalesce(n, 0) + 2)))::DOUBLE AS ls01, ((coalesce(w, 0) + 1) / (coalesce(n, 0) + 2))::DOUBLE AS ls, coalesce(net, 0.0) AS net, coalesce(fb, 0.0) AS fb,
  0.5 / (1 + clock - (d.doc_id + 1)) + 0.5 * coalesce(n, 0) / (coalesce(n, 0) + 1) AS strength, greatest(0.0, least(1.0, d.n_chars / 5000.0))::DOUBLE AS importance
  FROM documents d JOIN rk ON rk.id = d.doc_id LEFT JOIN p ON p.dst = d.doc_id, clk)"""


def _cell_sql(mode: str, name: str) -> str:
    similarity = "semantic" if mode == "knn" else "0.0::DOUBLE"
    salience = "0.7 * semantic + 0.3 * ls01" if mode == "knn" else "ls01"
    by_order = {"score": "ls", "votes": "net", "feedback": "fb", "salience": salience, "salience_weighted": f"0.4 * {similarity} + 0.3 * strength + 0.2 * importance + 0.1 * ls01"}
    shown = {"hybrid": "fused", "bm25": "lexical"}.get(mode) or by_order.get(name, similarity)
    keys = {"field": "n_chars, ", "field_desc": "lang DESC, ", "recency": "created_at DESC, "}.get(name) or ("" if mode == "scan" and name == "none" else f"{shown} DESC, ")
    return _bm25_sql(["the", "of", "license"], f"SELECT id, round(({shown})::DOUBLE, 4) AS score FROM al2 ORDER BY {keys}id LIMIT 12 OFFSET 3", _MODE_SQL.format(vote=_VOTE))


def _cell(mode: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = b.doc(spark, sf_dir).join(b.vec(spark, sf_dir).select("id", "embedding"), "id", "left").withColumn("importance", F.col("n_chars") / 5000.0)
        votes, clock = b.votes(spark, sf_dir), rows.agg(F.max("created_at")).first()[0] or 0
        text, near = ("text", TEXT, 40) if mode in ("bm25", "hybrid") else None, (VECTOR, 50) if mode in ("knn", "hybrid") else None
        return _score(retrieve.select(rows, text, near, _ORDERS[name], 3, 12, (), votes, votes.select(F.col("dst").alias("id")), clock), "id")

    return run


for _mode in _MODES:
    for _name in _ORDERS:
        if _name != "similarity" or _mode in ("knn", "hybrid"):  # without a vector it is an error
            QUERIES[f"mode_{_mode}_order_{_name}"] = _cell(_mode, _name)
            ORACLES[f"mode_{_mode}_order_{_name}"] = _cell_sql(_mode, _name)


# ---- graph ----
@query("SELECT 'orders:' || o_orderkey AS id, 0.0::DOUBLE AS score FROM orders WHERE o_custkey = 7")
def match_out(spark, sf_dir):
    return graph.match(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), "customer:7", [Step("placed")]).select("id", "score")


@query("SELECT 'customer:' || c_custkey AS id, 0.0::DOUBLE AS score FROM customer WHERE c_nationkey = 3")
def match_in(spark, sf_dir):
    return graph.match(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), "nation:3", [Step("in_nation", outgoing=False)]).select("id", "score")


@query("""SELECT 'part:' || l_partkey AS id, round(arg_min(coalesce(l_discount, 0), l_orderkey * 10 + l_linenumber), 4) AS score
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 7 GROUP BY l_partkey""")
def match_two_hop(spark, sf_dir):
    return _score(graph.match(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), "customer:7", [Step("placed"), Step("contains")]), "id")


@query("""SELECT 'part:' || l_partkey AS id, round(arg_min(coalesce(l_discount, 0), l_orderkey * 10 + l_linenumber), 4) AS score
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND l_quantity >= 30 AND l_returnflag = 'R' GROUP BY l_partkey""")
def match_edge_filter(spark, sf_dir):
    big = Step("contains", where=lambda e: Field("quantity", T.DoubleType()).compare(">=", 30) & Field("returnflag", T.StringType()).eq("R"))
    return _score(graph.match(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), "nation:3", [Step("in_nation", False), Step("placed"), big]), "id")


@query("SELECT count(*) AS count FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 0")
def match_count_walks(spark, sf_dir):
    steps = [Step("in_region", False), Step("in_nation", False), Step("placed")]
    n = graph.match_count(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), "region:0", steps)
    return n.select(F.col("count").cast("long").alias("count"))


_CHAIN = "SELECT 'turn:c' || conv_id || '_t' || turn AS s, 'turn:c' || conv_id || '_t' || (turn - 1) AS d FROM conversations WHERE turn > 0"


@query(f"""WITH RECURSIVE e AS ({_CHAIN}), k AS (SELECT 'turn:c' || conv_id || '_t' || turn AS id FROM conversations),
start AS (SELECT id FROM k WHERE id LIKE 'turn:c1\\_t%' ESCAPE '\\' ORDER BY length(id) DESC, id DESC LIMIT 1),
r AS (SELECT id, 0::BIGINT AS depth FROM start UNION SELECT e.d, r.depth + 1 FROM r JOIN e ON e.s = r.id JOIN k ON k.id = e.d)
SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def closure_chain(spark, sf_dir):
    """From the last turn of conversation 1 back to its first."""
    last = b.table(spark, sf_dir, "conversations").where("conv_id = 1").agg(F.max("turn")).first()[0]
    steps = [Step("follows_from")]
    return graph.closure(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), f"turn:c1_t{last}", steps, stored).select("id", "depth")


@query("""SELECT 'region:1' AS id, 0::BIGINT AS depth UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def closure_two_steps(spark, sf_dir):
    """Depth goes on counting through the second step."""
    return graph.closure(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), "region:1", [Step("in_region", False), Step("in_nation", False)], stored).select("id", "depth")


# ---- history ----
_HALF = "(SELECT (max(event_id) + 1) // 2 FROM events)"
_STATE = "SELECT id, event_type, value, created_at FROM (SELECT user_id AS id, event_type, value, event_id + 1 AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id + 1 <= {t}{mem}) WHERE r = 1 AND event_type <> 'error'"


def _half(log: DataFrame) -> int:
    """Half of the log's last time."""
    return (log.agg(F.max("ts")).first()[0] or 0) // 2


@query(_STATE.format(t=_HALF, mem=""))
def as_of_select(spark, sf_dir):
    log = b.mutations(spark, sf_dir)
    return temporal.records_as_of(log, ["event_type", "value"], _half(log))


@query(_STATE.format(t=10**9, mem=""))
def as_of_after_forget(spark, sf_dir):
    """Beyond the last mutation: the current state, without what was forgotten."""
    return temporal.records_as_of(b.mutations(spark, sf_dir), ["event_type", "value"], 10**9)


@query(f"SELECT count(*) AS count FROM ({_STATE.format(t=_HALF, mem='')})")
def as_of_count(spark, sf_dir):
    log = b.mutations(spark, sf_dir)
    return retrieve.count_rows(temporal.records_as_of(log, ["event_type"], _half(log)))


def _graph_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users relate to their event type at every event; an error forgets the user, and its edges so far."""
    e = b.table(spark, sf_dir, "events")
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    gone = F.col("event_type") == "error"
    return e.select((F.col("event_id") + 1).alias("ts"), F.when(gone, "FORGET").otherwise("RELATE").alias("kind"), user.alias("id"), user.alias("src"), F.concat(F.lit("type:"), "event_type").alias("dst"), F.lit("did").alias("name"), F.col("value").alias("weight"))


@query("""WITH g AS (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'error' AND event_id < {h} GROUP BY user_id),
live AS (SELECT e.* FROM events e LEFT JOIN g USING (user_id) WHERE e.event_type <> 'error' AND e.event_id < {h} AND (gone IS NULL OR gone < e.event_id))
SELECT 'type:' || event_type AS id, round(arg_min(value, event_id), 4) AS score FROM live WHERE user_id = (SELECT min(user_id) FROM live) GROUP BY event_type""".format(h=_HALF))
def as_of_match(spark, sf_dir):
    log = _graph_log(spark, sf_dir)
    edges = temporal.edges_as_of(log, _half(log)).withColumn("seq", F.col("ts"))
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    first = edges.agg(F.min(F.substring_index("src", ":", -1).cast("long"))).first()[0]
    return _score(graph.match(ids, edges, f"user:{first}", [Step("did")]), "id")


_HISTORY = "SELECT 'history:' || (event_id + 1) AS id, event_id + 1 AS ts, CASE WHEN event_type = 'error' THEN 'FORGET' ELSE 'INSERT' END AS kind, user_id AS subject, (event_id + 1)::FLOAT::DOUBLE AS score FROM events WHERE event_id + 1 > {t}"


@query(_HISTORY.format(t=400))
def history_since(spark, sf_dir):
    return temporal.history_since(b.mutations(spark, sf_dir), 400, ["id"]).withColumn("score", F.col("score").cast("double"))


@query(f"SELECT kind, count(*) AS n FROM ({_HISTORY.format(t=100)}) GROUP BY kind")
def history_delta_kinds(spark, sf_dir):
    return temporal.history_since(b.mutations(spark, sf_dir), 100, ["id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_STATE.format(t=10**9, mem=""))
def prune_then_as_of(spark, sf_dir):
    """At the horizon a compacted log reads as the whole one."""
    log, horizon = temporal.compact(b.mutations(spark, sf_dir))
    return temporal.records_as_of(log, ["event_type", "value"], horizon, horizon)


@query(_STATE.format(t=_HALF, mem=" AND user_id % 2 = 0"))
def memory_isolation(spark, sf_dir):
    """A memory's reads see its own mutations only."""
    log = b.mutations(spark, sf_dir)
    return temporal.records_as_of(log.where("mem = 'even'"), ["event_type", "value"], _half(log))


@query("SELECT CASE WHEN event_type = 'error' THEN 'FORGET' ELSE 'INSERT' END AS kind, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def changes_by_hour(spark, sf_dir):
    """The streaming counts as one batch."""
    e = b.table(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "error", "FORGET").otherwise("INSERT").alias("kind"))
    return changes.changes_per_window(e, "ts", "1 hour", "10 minutes").select("kind", F.col("window.start").alias("start"), "n")


# ---- the log as a store: statements over whole tables, then reads ----
_LIVE = "e AS (SELECT *, row_number() OVER (ORDER BY event_id) + 1 AS pos FROM events WHERE event_type <> 'error'), s AS (SELECT 'user:' || user_id AS id, arg_max(event_type, pos) AS event_type, arg_max(value, pos) AS value, max(pos) AS created_at FROM e GROUP BY user_id)"


def _user_log(spark: SparkSession, sf_dir: str) -> MutationLog:
    """CREATE TABLE user, then every event that is no error as an INSERT of its user, in order."""
    log = MutationLog(spark, new_folder(spark, "log"))
    log.create_table("user")
    events = b.table(spark, sf_dir, "events").where("event_type <> 'error'")
    log.insert("user", events.orderBy("event_id").select(F.col("user_id").alias("id"), "event_type", "value"))
    return log


def _third(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = b.table(spark, sf_dir, "events").where("user_id % 3 = 0").select("user_id").distinct()
    return users.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"))


@query("SELECT 'user' AS tbl, NULL::INT AS dim, 1::BIGINT AS ts UNION ALL SELECT 'place', 2, 2 UNION ALL SELECT 'place', NULL, 3")
def log_create_table(spark, sf_dir):
    """Declaring a table again changes its dimension; each declaration is in the history."""
    log = MutationLog(spark, new_folder(spark, "log"))
    for name, dim in (("user", None), ("place", 2), ("place", None)):
        log.create_table(name, dim)
    return log.history(0).select("tbl", "dim", "ts")


@query(f"WITH {_LIVE} SELECT id, created_at FROM s")
def log_insert(spark, sf_dir):
    """The last write of each id counts, at its time."""
    return _user_log(spark, sf_dir).records("user").select("id", "created_at")


@query(f"WITH {_LIVE} SELECT id, created_at FROM s WHERE event_type IN ('click', 'view') AND value > 25 AND value <> 60")
def log_document_filter(spark, sf_dir):
    """Predicates over keys of schemaless bodies, numbers of any kind and strings."""
    kind, value = DocField("event_type"), DocField("value")
    rows = _user_log(spark, sf_dir).records("user")
    return rows.where(kind.is_in(["click", "view", 3]) & value.compare(">", 25) & value.compare("!=", 60)).select("id", "created_at")


@query(f"WITH {_LIVE} SELECT id, ['value'] AS keys FROM s ORDER BY value DESC, id LIMIT 40 OFFSET 5")
def log_document_order(spark, sf_dir):
    """ORDER BY a key of the bodies, then a projection to it."""
    rows = _user_log(spark, sf_dir).records("user")
    ordered = retrieve.order_by_key(rows, rows, "value", descending=True, offset=5, limit=40)
    return retrieve.project_body(ordered, ["value", "nope"]).select("id", F.map_keys("body").alias("keys"))


@query(f"WITH {_LIVE} SELECT id, created_at FROM s WHERE substr(id, 6)::BIGINT % 3 <> 0")
def log_forget(spark, sf_dir):
    log = _user_log(spark, sf_dir)
    log.forget(_third(spark, sf_dir))
    return log.records("user").select("id", "created_at")


@query("SELECT 'type:' || event_type AS dst, count(*) AS n, round(sum(value::FLOAT)::DOUBLE, 1) AS weight FROM events WHERE user_id % 3 <> 0 GROUP BY event_type")
def log_relate(spark, sf_dir):
    """An edge an event, with its value as weight; forgetting a user takes its edges along."""
    log = MutationLog(spark, new_folder(spark, "log"))
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    log.relate_all(b.table(spark, sf_dir, "events").select(user.alias("src"), F.lit(":did").alias("name"), F.concat(F.lit("type:"), "event_type").alias("dst"), F.col("value").alias("Weight"), "user_id"))
    log.forget(_third(spark, sf_dir))
    sums = log.edges().where("name = 'did'").groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight").cast("double")).alias("weight"))
    return sums.select("dst", "n", F.round("weight", 1).alias("weight"))


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS pos FROM events WHERE event_type <> 'error') SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS mem, 'user:' || user_id AS id, max(pos) AS created_at FROM e GROUP BY user_id")
def log_memory(spark, sf_dir):
    """Each memory has its own records and its own clock."""
    log = MutationLog(spark, new_folder(spark, "log"))
    log.create_table("user")
    events = b.table(spark, sf_dir, "events").where("event_type <> 'error'")
    for name, rest in (("even", 0), ("odd", 1)):
        log.memory(name).insert("user", events.where(F.col("user_id") % 2 == rest).orderBy("event_id").select(F.col("user_id").alias("id"), "value"))
    frames = [log.memory(name).records("user").select(F.lit(name).alias("mem"), "id", "created_at") for name in ("even", "odd")]
    return frames[0].unionByName(frames[1])


@query(f"WITH {_LIVE} SELECT id, created_at FROM s WHERE substr(id, 6)::BIGINT % 3 <> 0")
def log_prune(spark, sf_dir):
    """A pruned log, opened again, reads as before at its horizon."""
    log = _user_log(spark, sf_dir)
    log.forget(_third(spark, sf_dir))
    log.prune()
    again = MutationLog(spark, log.path)
    return again.records("user", as_of=again.clock[""]).select("id", "created_at")

"""Token arrays of documents and positions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import labels as L
from slatewise.functions import numbers as N
from slatewise.functions import vectors as V
from slatewise.operators import sequences as S
from slatewise.registry import Tables, query, sql_tokens

_WORDS = "list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')"


def _words():
    return F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")


@query("""WITH p AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE)::VARCHAR AS run, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, event_id) - 1 AS k FROM events WHERE value >= 0.1),
v AS (SELECT user_id, event_type, sum(1.0 / (0.1 * k + 1)) AS score FROM p GROUP BY ALL) SELECT user_id, event_type, round(score::DOUBLE, 6) AS score, round((score / sum(score) OVER (PARTITION BY user_id))::DOUBLE, 6) AS probability FROM v""")
def reciprocal_vote(t: Tables) -> DataFrame:
    """Days are runs."""
    e = t.events.withColumn("run", F.to_date("ts"))
    out = S.reciprocal_votes(e, "user_id", "run", "event_type", [F.col("value").desc(), F.col("event_id")], F.col("value") >= 0.1)
    return out.select("user_id", "event_type", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


@query("SELECT a.n_nationkey AS position, a.n_name, b.r_name FROM nation a JOIN region b ON b.r_regionkey = a.n_nationkey % 5")
def position_zip(t: Tables) -> DataFrame:
    """D5 D13."""
    a = t.nation.select(F.col("n_nationkey").alias("position"), "n_name")
    return S.zip_by_position(a, t.region.select(F.col("r_regionkey").alias("position"), "r_name"), "position")


@query(f"""WITH d AS (SELECT doc_id, source, {_WORDS} AS w FROM documents WHERE source IS NOT NULL), p AS (SELECT *, sum(len(w)) OVER (PARTITION BY source ORDER BY doc_id) - len(w) AS s FROM d),
e AS (SELECT source, unnest(w) AS token, s + generate_subscripts(w, 1) - 1 AS place FROM p) SELECT source, floor(place / 128)::BIGINT AS block, string_agg(token, ' ' ORDER BY place) AS tokens, count(*) AS n FROM e GROUP BY ALL""")
def token_blocks(t: Tables) -> DataFrame:
    """Words of a source in blocks of 128."""
    rows = t.documents.filter("source IS NOT NULL").select("source", "doc_id", _words().alias("ids"))
    out = S.token_blocks(rows, "source", "doc_id", "ids", 128)
    return out.select("source", "block", F.array_join("ids", " ").alias("tokens"), F.size("ids").cast("bigint").alias("n"))


@query()
def exact_subsample(t: Tables) -> DataFrame:
    """D3: a tenth, exactly; the hash is Spark's, so there is no SQL twin."""
    return S.subsample(t.documents.select("doc_id", "source"), "doc_id", 0.1)


@query()
def weighted_resample(t: Tables) -> DataFrame:
    """As many draws as documents, weighted by length; the blocks are Spark's hashes."""
    d = t.documents.filter("n_chars > 0").select("doc_id", "n_chars")
    return S.resampled(d, "doc_id", "n_chars", t.documents.count())


@query(f"""WITH d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: length(x)) AS a FROM documents)
SELECT doc_id, array_to_string(list_concat(list_concat([0], a), [-1]), ',') AS framed, array_to_string(a[1:5], ',') AS first, array_to_string(list_transform(a, lambda x: x + 10), ',') AS moved,
array_to_string(list_filter(a, lambda x: x <> 3), ',') AS stripped, array_to_string(list_transform(a, lambda x: CASE WHEN x = 3 THEN 99 ELSE x END), ',') AS replaced,
CASE WHEN len(a) = 0 THEN '' ELSE array_to_string(list_concat(a[len(a):len(a)], a[1:len(a) - 1]), ',') END AS rolled, array_to_string(list_concat(a[1:5], list_transform(range(0, 5 - least(len(a), 5)), lambda i: 0)), ',') AS padded, len(a)::INT AS n FROM d""")
def array_token_suite(t: Tables) -> DataFrame:
    """D7 D8 D15."""
    a = F.transform(_words(), lambda x: F.length(x))
    show = lambda c: F.array_join(c, ",")
    d = t.documents.select("doc_id", a.alias("a"))
    c = F.col("a")
    return d.select(
        "doc_id", show(S.framed(c, F.lit(0), F.lit(-1))).alias("framed"), show(S.truncated(c, 5)).alias("first"), show(S.offset(c, 10)).alias("moved"), show(S.stripped(c, F.lit(3))).alias("stripped"),
        show(S.replaced(c, F.lit(3), F.lit(99))).alias("replaced"), show(S.rolled(c, 1)).alias("rolled"), show(S.padded(S.truncated(c, 5), F.lit(5), F.lit(0))).alias("padded"), F.size(c).alias("n"),
    )


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, i::INT AS pos, array_to_string(w[greatest(i - 3, 0) + 1 : i], ' ') AS before FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d WHERE len(w) <= 60)")
def context_windows(t: Tables) -> DataFrame:
    """Up to three words before each word, in texts of at most 60 words; ``context_windows_all`` takes texts of any length."""
    d = S.length_filtered(t.documents.select("doc_id", _words().alias("w")), "w", 60)
    return d.select("doc_id", F.posexplode(S.context_windows(F.col("w"), 3)).alias("pos", "x")).select("doc_id", "pos", F.array_join("x", " ").alias("before"))


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, i::INT AS pos, array_to_string(w[greatest(i - 3, 0) + 1 : i], ' ') AS before FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)")
def context_windows_all(t: Tables) -> DataFrame:
    """Up to three words before each word, in all texts."""
    d = t.documents.select("doc_id", _words().alias("w"))
    return d.select("doc_id", F.posexplode(S.context_windows(F.col("w"), 3)).alias("pos", "x")).select("doc_id", "pos", F.array_join("x", " ").alias("before"))


@query()
def token_budget_batches(t: Tables) -> DataFrame:
    """Greedy, so there is no SQL twin. A part is a slice of 1,000 neighbouring documents of a source."""
    rows = t.documents.select(F.concat_ws(":", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string")).alias("part"), "doc_id", _words().alias("ids"))
    return S.budget_batches(rows, "part", "doc_id", "ids", 4096)


@query()
def noised_tokens(t: Tables) -> DataFrame:
    """Seeded coins of Spark's hash, so there is no SQL twin."""
    w = t.documents.select("doc_id", _words().alias("w"))
    key, c = F.col("doc_id"), F.col("w")
    return w.select("doc_id", F.size(S.dropped_out(c, key, 0.1)).alias("kept"), S.masked(c, key, 0.15, F.lit("<mask>")).alias("masked"), S.shuffled(c, key, 3).alias("shuffled"))


@query("SELECT p_partkey, levenshtein(p_brand, p_type)::INT AS chars, CASE WHEN w1 = w2 THEN 0 ELSE 1 END + CASE WHEN v1 = v2 THEN 0 ELSE 1 END AS edits FROM (SELECT p_partkey, p_brand, p_type, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS v1, 'small' AS w2, 'steel' AS v2 FROM part) WHERE w1 <> v2 AND v1 <> w2")
def token_levenshtein(t: Tables) -> DataFrame:
    """words, not signs, against ``small steel`` (names that share no word crosswise)."""
    name = F.split("p_name", " ")
    rows = t.part.filter((F.get(name, F.lit(0)) != "steel") & (F.get(name, F.lit(1)) != "small"))
    return rows.select("p_partkey", F.levenshtein("p_brand", "p_type").alias("chars"), S.token_levenshtein(name, F.array(F.lit("small"), F.lit("steel"))).alias("edits"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part), v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS k FROM w GROUP BY token)
SELECT p_partkey, array_to_string(list(CASE WHEN k < 10 THEN k ELSE -1 END ORDER BY i), ',') AS ids, string_agg(CASE WHEN k < 10 THEN token END, '; ' ORDER BY i) AS names, printf('P%04d', p_partkey) AS code FROM w JOIN v USING (token) GROUP BY p_partkey""")
def label_encode_decode(t: Tables) -> DataFrame:
    """The ten most frequent words have ids; others are unknown and vanish on decoding."""
    from slatewise.operators.memory import vocabulary

    words = t.part.select("p_partkey", F.split("p_name", " ").alias("w"))
    counts = words.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    v = vocabulary(counts).filter("token_index < 10").select("token", "token_index")
    coded = S.encoded_labels(words, "p_partkey", F.col("w"), v, -1, -2)
    names = v.agg(F.transform(F.array_sort(F.collect_list(F.struct("token_index", "token"))), lambda x: x["token"]).alias("names"))
    back = F.array_join(S.decoded_labels(F.filter("ids", lambda i: i >= 0), F.col("names")), "; ")
    return coded.crossJoin(F.broadcast(names)).select("p_partkey", F.array_join("ids", ",").alias("ids"), F.nullif(back, F.lit("")).alias("names"), L.row_code("P", F.col("p_partkey")).alias("code"))


@query(rf"""SELECT row_id, CASE WHEN coalesce(reactants, '') = '' THEN 0 ELSE len(string_split(reactants, '.')) END::INT AS components, regexp_replace(product, ':[0-9]+', '', 'g') AS unmapped, len(regexp_extract_all(product, '\[[^\[\]]+\]'))::INT AS brackets,
split_part(reactants || '>>' || product, '>>', 2) AS right_side, length(product)::INT AS product_length, len({sql_tokens('solvent_norm')})::INT AS labels, array_to_string({sql_tokens('solvent_norm')}, '; ') AS cell FROM condition_rows""")
def text_scalar_suite(t: Tables) -> DataFrame:
    """F2 F33 P4 P9."""
    c = F.col
    sides = L.reaction_sides(F.concat("reactants", F.lit(">>"), "product"))
    return t.condition_rows.select(
        "row_id", L.component_count(c("reactants")).alias("components"), L.strip_atom_maps(c("product")).alias("unmapped"), F.size(F.regexp_extract_all("product", F.lit(r"\[[^\[\]]+\]"), F.lit(0))).alias("brackets"),
        sides["product"].alias("right_side"), F.length("product").alias("product_length"), L.token_count(c("solvent_norm")).alias("labels"), F.array_join(L.tokens(c("solvent_norm")), "; ").alias("cell"),
    )


@query("SELECT row_id, true AS lossless FROM condition_rows WHERE product IS NOT NULL")
def molecule_tokens(t: Tables) -> DataFrame:
    """the tokens make up the molecule again."""
    rows = t.condition_rows.filter("product IS NOT NULL")
    return rows.select("row_id", L.is_lossless(F.col("product")).alias("lossless"))


@query("SELECT row_id, array_to_string(list_sort(list_distinct(string_split(reactants, '.'))), '.') = array_to_string(list_sort(list_distinct(string_split(product || '.' || reactants, '.'))), '.') AS same FROM condition_rows WHERE reactants IS NOT NULL AND product IS NOT NULL")
def component_set_equality(t: Tables) -> DataFrame:
    """F38."""
    rows = t.condition_rows.filter("reactants IS NOT NULL AND product IS NOT NULL")
    return rows.select("row_id", L.same_components(F.col("reactants"), F.concat_ws(".", "product", "reactants")).alias("same"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '-?[0-9.]+', 0) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none FROM events")
def safe_float(t: Tables) -> DataFrame:
    """F3."""
    return t.events.select("event_id", N.safe_float(F.regexp_extract("props", "-?[0-9.]+", 0)).alias("k"), N.safe_float(F.col("event_type")).alias("none"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN greatest(k, k + 20)::DOUBLE WHEN 1 THEN (k + k + 10) / 2.0 WHEN 2 THEN NULL ELSE k::DOUBLE END AS temperature FROM (SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)""")
def temperature_parse(t: Tables) -> DataFrame:
    """two stages, a range, a bad part, one number."""
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    s = k.cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(s, F.lit("; "), (k + 20).cast("string"))).when(F.col("event_id") % 4 == 1, F.concat(s, F.lit(" - "), (k + 10).cast("string"))).when(F.col("event_id") % 4 == 2, F.concat(s, F.lit("; x"))).otherwise(s)
    return t.events.select("event_id", N.highest_temperature(text).alias("temperature"))


@query("SELECT row_id, round(ln(1 + yield_value), 6) AS prior, round(CASE WHEN yield_value >= 50 THEN -ln(1 + exp(-(yield_value - 50))) ELSE (yield_value - 50) - ln(1 + exp(yield_value - 50)) END, 6) AS log_sigmoid, CASE WHEN yield_value <= 0 THEN 0.0 ELSE round(2 * yield_value / 100 + 2, 6) END::DOUBLE AS relevance, printf('%.2f%%', yield_value) AS shown FROM condition_rows WHERE yield_value >= 0 AND NOT isnan(yield_value)")
def number_scalar_suite(t: Tables) -> DataFrame:
    """F40 F42 F43."""
    y = F.col("yield_value")
    rows = t.condition_rows.filter("yield_value >= 0 AND NOT isnan(yield_value)")
    return rows.select("row_id", F.round(N.log_prior(y), 6).alias("prior"), F.round(N.log_sigmoid(y - 50), 6).alias("log_sigmoid"), F.round(N.yield_relevance(y), 6).alias("relevance"), F.format_string("%.2f%%", y).alias("shown"))


@query("SELECT vec_id, label, list_transform(range(0, 10), lambda i: (i = label)::INT) AS hot FROM embeddings")
def multi_hot_labels(t: Tables) -> DataFrame:
    """F46."""
    return t.embeddings.select("vec_id", "label", V.multi_hot(F.array("label"), 10).alias("hot"))


@query("""SELECT row_id, coalesce(reagent_norm, '') AS reagent, CASE WHEN coalesce(trim(product, ' '), '') = '' THEN reactants ELSE product END AS canonical, 0.0::DOUBLE AS exact_count, 0.0::DOUBLE AS scaffold_count, coalesce(CASE WHEN isnan(yield_value) THEN 0 ELSE yield_value END, 0) AS yield_value FROM condition_rows""")
def feature_projection(t: Tables) -> DataFrame:
    """Coalesced keys, zero-filled support columns, missing numbers as 0."""
    from slatewise.operators.features import filled, feature_columns, text, zero_support

    rows = zero_support(t.condition_rows, ["exact_count", "scaffold_count"])
    rows = rows.select("row_id", text("reagent_norm").alias("reagent"), filled(F.col("product"), F.col("reactants")).alias("canonical"), "exact_count", "scaffold_count", "yield_value")
    return feature_columns(rows, ["row_id", "reagent", "canonical"], ["exact_count", "scaffold_count", "yield_value"])

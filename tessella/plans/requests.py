"""Requests, sessions and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import filters, nlu, sessions
from ..sources.stage import written
from ..sources.tables import read_table
from ..streaming import events as EV
from .base import CATALOGUE, catalogue, query

#: Requests that the catalogue's own words make, by item modulo 8, and every turn of the conversations.
_TEMPLATES = (
    ("'a '", "colour", "' '", "garment", "' for '", "kind"),
    ("garment", "' but without '", "colour", "', not '", "kind"),
    ("'no '", "colour", "', only the '", "garment"),
    ("colour", "' '", "garment", "' to go with this '", "kind", "' shirt'"),
    ("'what goes really well with my '", "garment", "' boots'"),
    ("'this '", "garment", "' in another colour'"),
    ("'hello, how is the '", "colour", "' weather'"),
    ("name", "' in '", "colour"),
)
_LABELS = ("similar", "pairing", "variant", "chitchat", "composite", "greeting")
_OFFSET = 10_000_000
_LABEL_SQL = "CASE CAST(floor(item / 8) AS BIGINT) % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LABELS)) + " END"
_TEXT_SQL = "CASE item % 8 " + " ".join(f"WHEN {i} THEN {' || '.join(t)}" for i, t in enumerate(_TEMPLATES)) + " END"
_REQ = f"""{CATALOGUE}, req AS (SELECT item AS id, {_TEXT_SQL} AS text, {_LABEL_SQL} AS label FROM (SELECT *, lower(product_type) AS kind FROM cat)
UNION ALL SELECT {_OFFSET} + conv_id * 1000 + turn, text, 'greeting' FROM conversations)"""
_FOLD = f"translate(lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')), '{TX.ACCENTED}', '{TX.FOLDED}')"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_ANY = lambda words, c="t": "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_HITS = f"""{_REQ}, lex AS (SELECT 'colour_group' AS field, colour AS surface, min(colour) AS value FROM cat GROUP BY 2 UNION ALL SELECT 'garment', garment, min(garment) FROM cat GROUP BY 2 UNION ALL SELECT 'product_type', lower(product_type), min(product_type) FROM cat GROUP BY 2),
tok AS (SELECT id, list_filter(string_split(regexp_replace(regexp_replace(replace(replace({_FOLD}, chr(39), ''), '’', ''), '[,;.!?]+', ' clausebreak ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM req),
pos AS (SELECT id, w, unnest(w) AS surface, generate_subscripts(w, 1) AS p FROM tok), one AS (SELECT id, surface, min(p) AS p, any_value(w) AS w FROM pos GROUP BY 1, 2),
hit AS (SELECT id, field, value, surface, coalesce(list_filter(list_reverse(list_slice(w, greatest(p - {nlu.NEGATION_WINDOW}, 1), p - 1)), lambda x: x IN {_IN((*nlu.NEGATIONS, *nlu.NEGATION_STOPS))})[1] IN {_IN(nlu.NEGATIONS)}, false) AS neg FROM one JOIN lex USING (surface)),
best AS (SELECT *, row_number() OVER (PARTITION BY id, field, neg ORDER BY length(surface) DESC, surface) AS r FROM hit)"""


def _requests(spark, sf_dir):
    cat = catalogue(spark, sf_dir).withColumn("kind", F.lower("product_type"))
    part = lambda x: F.lit(x[1:-1]) if x.startswith("'") else F.col(x)
    text, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, t in enumerate(_TEMPLATES):
        text = F.when(F.col("item") % 8 == i, F.concat(*[part(x) for x in t])).otherwise(text)
    for i, x in enumerate(_LABELS):
        label = F.when(F.floor(F.col("item") / 8) % 6 == i, x).otherwise(label)
    turns = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + _OFFSET).alias("id"), "text", F.lit("greeting").alias("label"))
    return cat.select(F.col("item").alias("id"), text.alias("text"), label.alias("label")).unionByName(turns)


def _lexicon(spark, sf_dir):
    """Types, colours and garments of the catalogue."""
    cat = catalogue(spark, sf_dir)
    fields = F.create_map(F.lit("colour_group"), F.col("colour"), F.lit("garment"), F.col("garment"), F.lit("product_type"), F.col("product_type"))
    # written, so that the optimiser knows how small it is before the words of all requests are shuffled
    return written(nlu.lexicon_of(cat.select(F.explode(fields).alias("field", "value")).distinct()), "lexicon")


def _attributes(spark, sf_dir, negative=False):
    return nlu.extract_attributes(_requests(spark, sf_dir), "id", "text", _lexicon(spark, sf_dir), negative=negative)


@query(f"WITH {_HITS} SELECT id, field, value FROM best WHERE NOT neg AND r = 1")
def gazetteer_extract(spark, sf_dir):
    """Attributes that requests ask for, by the words of the catalogue."""
    return _attributes(spark, sf_dir).select("id", "field", "value")


@query(f"WITH {_HITS} SELECT id, field, value FROM best WHERE neg AND r = 1")
def gazetteer_negated(spark, sf_dir):
    return _attributes(spark, sf_dir, True).select("id", "field", "value")


@query(f"WITH {_HITS}, pn AS (SELECT id, field, max(CASE WHEN NOT neg AND r = 1 THEN value END) AS yes, max(CASE WHEN neg AND r = 1 THEN value END) AS no FROM best GROUP BY 1, 2) SELECT id, count(yes) AS n_must, count(CASE WHEN no IS NOT NULL AND yes IS NULL THEN 1 END) AS n_must_not FROM pn GROUP BY 1")
def positive_beats_negative(spark, sf_dir):
    """How many fields are asked for, and forbidden and not asked for."""
    both = [a.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias(n)) for a, n in ((_attributes(spark, sf_dir), "must"), (_attributes(spark, sf_dir, True), "must_not"))]
    none = F.create_map().cast("map<string,string>")
    x = both[0].join(both[1], "id", "full").select("id", F.coalesce("must", none).alias("must"), F.coalesce("must_not", none).alias("must_not"))
    return x.select("id", F.size("must").cast("long").alias("n_must"), F.size(filters.drop_contradictions(F.col("must_not"), F.col("must"))).cast("long").alias("n_must_not"))


_ALIAS = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in nlu.INTENT_ALIASES.items()) + f" ELSE '{nlu.SIMILAR}' END"
_RULE = f"""{_HITS}, col AS (SELECT DISTINCT id, true AS c FROM best WHERE field = 'colour_group' AND NOT neg AND r = 1), x AS (SELECT id, {_FOLD} AS t, {_ALIAS} AS hint, coalesce(c, false) AS c FROM req LEFT JOIN col USING (id)),
y AS (SELECT *, regexp_matches(t, '(#|\\b)\\d{{6,10}}\\b') OR {_ANY(nlu.ANCHORS)} AS anchor, {_ANY(nlu.PAIRING)} AS pairing, {_ANY(nlu.STRONG_PAIRING)} OR regexp_matches(t, '{nlu.STRONG_PAIRING_ADVERB}') AS strong, {_ANY(nlu.COLOUR_WORDS)} AND {_ANY(nlu.VARIANT_WORDS)} AS phrase FROM x),
z AS (SELECT *, phrase OR (c AND regexp_matches(t, '\\bin\\b')) AS variant, (anchor AND pairing) OR strong AS pair, t <> '' AND (list_has_any(regexp_extract_all(t, '[a-z]+'), [{", ".join(f"'{w}'" for w in nlu.FASHION)}]) OR contains(t, 't shirt') OR anchor) AS fashion FROM y),
i AS (SELECT id, CASE WHEN hint IN ('{nlu.CHAT}', '{nlu.COMPOSITE}') AND pair THEN '{nlu.GRAPH}|override_to_graph_pairing' WHEN hint IN ('{nlu.CHAT}', '{nlu.COMPOSITE}') AND anchor AND variant THEN '{nlu.VARIANT}|override_to_color_variant'
 WHEN hint = '{nlu.CHAT}' AND fashion THEN '{nlu.SIMILAR}|override_chit_chat_to_similar' WHEN hint IN ('{nlu.CHAT}', '{nlu.COMPOSITE}') THEN hint || '|pass_through' WHEN t = '' THEN '{nlu.SIMILAR}|empty_query_default_similar'
 WHEN hint IN ('{nlu.GRAPH}', '{nlu.VARIANT}') AND NOT (anchor OR pairing OR strong OR phrase) THEN '{nlu.SIMILAR}|demote_referentless_to_similar' WHEN hint IN ('{nlu.GRAPH}', '{nlu.VARIANT}') THEN hint || '|trust_classifier'
 WHEN anchor AND variant THEN '{nlu.VARIANT}|explicit_color_variant' WHEN pair THEN '{nlu.GRAPH}|explicit_graph_pairing' ELSE hint || '|trust_classifier' END AS ir FROM z)"""


def _intents(spark, sf_dir):
    r = _requests(spark, sf_dir)
    colour = _attributes(spark, sf_dir).where("field = 'colour_group'").select("id", F.lit(True).alias("c"))
    return r.join(colour, "id", "left").select("id", "text", nlu.intent_rules("text", nlu.normalize_intent("label"), F.coalesce("c", F.lit(False))).alias("r")).select("id", "text", "r.intent", "r.rule")


@query(f"WITH {_RULE} SELECT id, split_part(ir, '|', 1) AS intent, split_part(ir, '|', 2) AS rule FROM i")
def intent_rules(spark, sf_dir):
    return _intents(spark, sf_dir).drop("text")


_CUES = ("colour", "color")


@query(f"""WITH {_RULE}, sx AS (SELECT id, split_part(ir, '|', 1) AS intent, coalesce(lag(split_part(ir, '|', 1)) OVER w, '') AS before, row_number() OVER w > 1 AS anchored, id % 5 = 0 AS image, lower(coalesce(text, '')) AS low
 FROM i JOIN req USING (id) WINDOW w AS (PARTITION BY id // 8 ORDER BY id)),
sy AS (SELECT *, CASE WHEN anchored AND {_ANY(_CUES, "low")} AND intent = '{nlu.SIMILAR}' THEN '{nlu.VARIANT}' WHEN contains(low, ' in ') AND before IN ('{nlu.GRAPH}', '{nlu.VARIANT}') AND anchored AND intent = '{nlu.SIMILAR}' THEN before
 WHEN image AND intent IN ('{nlu.CHAT}', '{nlu.COMPOSITE}') THEN '{nlu.SIMILAR}' ELSE intent END AS final FROM sx)
SELECT id, intent, final, CASE WHEN final = '{nlu.COMPOSITE}' THEN 'composite' WHEN final = '{nlu.CHAT}' THEN 'chit_chat' WHEN final IN ('{nlu.GRAPH}', '{nlu.VARIANT}') AND NOT anchored THEN 'needs_reference' END AS answer FROM sy""")
def session_routes(spark, sf_dir):
    """Every request after the session's last one; sessions are runs of eight ids, and every fifth id has an image."""
    w = Window.partitionBy(F.floor(F.col("id") / 8)).orderBy("id")
    r = _intents(spark, sf_dir).withColumn("before", F.coalesce(F.lag("intent").over(w), F.lit(""))).withColumn("anchored", F.row_number().over(w) > 1)
    low = F.lower(F.coalesce("text", F.lit("")))
    cue = low.contains(_CUES[0]) | low.contains(_CUES[1])
    final = nlu.route(F.col("intent"), F.col("anchored"), F.col("id") % 5 == 0, F.col("before"), variant_cue=cue, refinement=low.contains(" in "))
    return r.withColumn("final", final).select("id", "intent", "final", nlu.direct_response(F.col("final"), F.col("anchored")).alias("answer"))


_LOW = "lower(coalesce(text, ''))"
_TARGET_SQL = f"left({_LOW}, least(" + ", ".join(f"CASE WHEN contains({_LOW}, '{c}') THEN strpos({_LOW}, '{c}') - 1 ELSE length({_LOW}) END" for c in nlu.CONNECTIVES) + "))"
_SLOT_SQL = "CASE " + " ".join(f"WHEN {_ANY(words)} THEN '{slot}'" for slot, words in nlu.SLOT_WORDS) + " ELSE '' END"


@query(f"WITH {_REQ} SELECT id, md5({_TARGET_SQL}) AS target FROM req")
def target_part(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", F.md5(nlu.target_part("text")).alias("target"))


@query(f"WITH {_REQ}, f AS (SELECT id, {_FOLD} AS t FROM req) SELECT id, {_SLOT_SQL} AS slot FROM f")
def slot_from_text(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", nlu.slot_from_text("text").alias("slot"))


_FULL = f"""{_RULE}, tt AS (SELECT id, {_TARGET_SQL} AS t FROM req), pt AS (SELECT id, list_filter(string_split(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM tt),
kinds AS (SELECT id, min(value) AS kind FROM (SELECT id, unnest(w) AS surface FROM pt) JOIN lex USING (surface) WHERE field = 'product_type' GROUP BY 1),
tints AS (SELECT DISTINCT id, true AS on_target FROM (SELECT id, unnest(w) AS surface FROM pt) JOIN lex USING (surface) WHERE field = 'colour_group'),
a AS (SELECT id, max(CASE WHEN field = 'colour_group' THEN value END) AS colour, max(CASE WHEN field = 'garment' THEN value END) AS garment, max(CASE WHEN field = 'product_type' THEN value END) AS kind FROM best WHERE NOT neg AND r = 1 GROUP BY 1)
SELECT id, md5(coalesce(text, '')) AS search, coalesce(CASE WHEN ir LIKE '{nlu.GRAPH}%' AND NOT coalesce(on_target, false) THEN '' ELSE colour END, '') AS colour, coalesce(garment, '') AS garment,
coalesce(nullif(CASE WHEN ir LIKE '{nlu.GRAPH}%' THEN coalesce(kinds.kind, '') ELSE coalesce(a.kind, '') END, ''), CASE WHEN id % 3 = 1 THEN 'PROMO' END, '') AS kind
FROM req JOIN i USING (id) LEFT JOIN a USING (id) LEFT JOIN kinds USING (id) LEFT JOIN tints USING (id)"""


@query(f"WITH {_FULL}")
def full_analysis(spark, sf_dir):
    """Rewrite, lexicon and a model's type merged into a search text and hard filters, as columns.

    Of the models' answers, the rewrite has a placeholder and the type is vague, a real one, or none, by id modulo 3.
    """
    r = _intents(spark, sf_dir)
    none = F.create_map().cast("map<string,string>")
    found = _attributes(spark, sf_dir).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("found"))
    # the part before the connective has no negation to heed
    words = r.select("id", F.explode(F.array_distinct(F.filter(F.split(F.regexp_replace(nlu.target_part("text"), "[^a-z0-9]+", " "), " "), lambda w: w != ""))).alias("surface")).join(_lexicon(spark, sf_dir), "surface")
    target = words.groupBy("id").agg(F.min(F.when(F.col("field") == "product_type", F.col("value"))).alias("kind"), F.bool_or(F.col("field") == "colour_group").alias("on_target"))
    x = r.join(found, "id", "left").join(target, "id", "left")
    asked = F.when(F.col("id") % 3 == 0, "gala attire").when(F.col("id") % 3 == 1, "PROMO")
    a = nlu.analyse(F.coalesce("text", F.lit("")), F.lit("a [colour] item"), F.col("intent"), F.coalesce("found", none), F.coalesce("kind", F.lit("")), F.coalesce("on_target", F.lit(False)), asked)
    value = lambda k: F.coalesce(F.try_element_at("a.must", F.lit(k)), F.lit(""))
    return x.select("id", a.alias("a")).select("id", F.md5("a.search").alias("search"), value("colour_group").alias("colour"), value("garment").alias("garment"), value("product_type").alias("kind"))


@query(f"WITH f AS (SELECT conv_id, turn, {_FOLD} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN {_ANY(nlu.SLOT_WORDS[0][1])} THEN 'shoe' ELSE '' END AS slot FROM f")
def shoe_mentions(spark, sf_dir):
    slot = nlu.slot_from_text(F.col("text"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(slot == "shoe", slot).otherwise("").alias("slot"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), l AS (SELECT *, list_max([length(x) FOR x IN t]) AS most FROM w), p AS (SELECT doc_id, t, list_position([length(x) FOR x IN t], most) AS place FROM l)
SELECT doc_id, 'LONG' AS field, array_to_string(list_slice(t, place, place + 1), ' ') AS surface FROM p WHERE place IS NOT NULL""")
def bio_decode(spark, sf_dir):
    """A span, the first longest word with the next one, laid as tags over the words of every whole document and read back."""
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("t"))
    size = F.transform("t", lambda x: F.length(x))
    # found once for a document, before its words become rows
    docs = docs.select("doc_id", "t", F.array_position(size, F.array_max(size)).alias("at"))
    rows = docs.select("doc_id", "at", F.posexplode("t").alias("pos", "token"))
    at = F.col("pos") + 1 - F.col("at")
    tagged = rows.select("doc_id", "pos", "token", F.when(at == 0, "B-LONG").when(at == 1, "I-LONG").otherwise("O").alias("tag"))
    return nlu.bio_spans(tagged, "doc_id")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_turn FROM conversations")
def session_anchor_fold(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", sessions.last_known(F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").alias("last_user_turn"))


@query("SELECT conv_id, turn, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE trim(text) <> '') WHERE back <= 12")
def bounded_history(spark, sf_dir):
    return sessions.bounded_history(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "back")


_SESSIONS = "WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)"


@query(f"{_SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY 1, 2")
def session_ttl(spark, sf_dir):
    s = sessions.sessionize(read_table(spark, sf_dir, "events"), "user_id", "ts")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("WITH s AS (SELECT user_id, max(ts) AS updated FROM events GROUP BY 1), n AS (SELECT max(updated) AS now FROM s) SELECT user_id FROM s, n WHERE updated >= now - INTERVAL 6 HOURS ORDER BY updated DESC, user_id LIMIT 500")
def session_eviction(spark, sf_dir):
    s = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated"))
    now = s.agg(F.max("updated").alias("now"))
    return sessions.evict(s.crossJoin(F.broadcast(now)), "updated", "user_id", now=F.col("now")).select("user_id")


@query("SELECT event_type, count(*) AS n, min(k) AS least, max(k) AS most, round(median(k), 6) AS middle FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def log_latency_stats(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.percentile("k", 0.5), 6).alias("middle"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    """The batch twin of the streaming query: the same function on the same rows."""
    e = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return EV.tumbling(e).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT epoch(time_bucket(INTERVAL 15 MINUTES, ts)) AS b, event_type, value FROM events), x AS (SELECT b - 900 * o AS start, event_type, value FROM w, range(4) t(o)) SELECT CAST(start AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1, 2")
def events_sliding(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return EV.sliding(e).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 MINUTES) AS stop, count(*) AS n FROM s GROUP BY user_id, session")
def events_sessions(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return EV.session_windows(e).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def events_stream_dedup(spark, sf_dir):
    """A stream over the events table: each id once within the watermark, counted per type."""
    s = spark.readStream.schema(EV.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = EV.run_to_table(EV.deduplicated(s, "40 days").select("event_id", "event_type"), "dedup")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {CATALOGUE} SELECT item, CASE WHEN length(name) > 8 THEN regexp_replace(substr(name, 1, 8), ' [^ ]*$', '') || '...' ELSE name END AS short FROM cat")
def context_lines(spark, sf_dir):
    return catalogue(spark, sf_dir).select("item", TX.shorten("name", 8).alias("short"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def history_digest(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.md5(TX.history_lines(F.col("t"))).alias("digest"))


@query("SELECT event_id, props AS found FROM events")
def json_from_prose(spark, sf_dir):
    """The last object in a text that has others, and braces that are none, before it; odd texts are in the tests."""
    e = read_table(spark, sf_dir, "events")
    prose = F.concat(F.lit('so {this} is {"a": {"b": 1}} and then '), "props", F.lit(" done"))
    return e.select("event_id", TX.last_json_object(prose).alias("found"))

"""Catalogue: lexicons, language models, decoding, annotations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strideframe.operators import annotation as an, decode as dc, hierarchy as hy, hmm, lexicon as lx, syllables as sy
from strideframe.plans.common import E_SQL, V_SQL, events, vectors
from strideframe.plans.model_queries import _D_SQL
from strideframe.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


_WORDS_SQL = """t AS (SELECT conv_id * 100 + turn AS utt_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda q: q <> '') AS words FROM conversations)"""


def _turns(spark, d):
    c = table(spark, d, "conversations")
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("utt_id"), words.alias("words"))


def _lexicon(spark, d):
    """Words of the user's turns, spelled; the tokens are their characters."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    words = c.select(F.explode(F.split("text", r"[ \n]+")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", F.split("word", "").alias("tokens"))


_LEX_SQL = "x AS (SELECT DISTINCT word, string_split(word, '') AS tokens FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM conversations WHERE role = 'user') WHERE word <> '')"


@query(f"WITH {_WORDS_SQL}, {_LEX_SQL}, w AS (SELECT utt_id, k - 1 AS pos, words[k] AS word FROM t, LATERAL unnest(generate_series(1, len(words))) AS u(k)) SELECT utt_id, CAST(pos AS INTEGER) AS pos, w.word, CAST(len(tokens) AS INTEGER) AS n_tokens FROM w LEFT JOIN x ON x.word = w.word")
def lexicon_lookup(spark, d):
    rows = lx.tokenize_words(_turns(spark, d), _lexicon(spark, d))
    return rows.select("utt_id", "pos", "word", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"))


@query(f"WITH {_WORDS_SQL}, {_LEX_SQL} SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM t) WHERE word NOT IN (SELECT word FROM x) GROUP BY word")
def oov_report(spark, d):
    return lx.oov_report(_turns(spark, d), _lexicon(spark, d))


@query(f"WITH {_LEX_SQL} SELECT word, round(0.9::DOUBLE / count(*) OVER (), 9) AS p FROM x UNION ALL SELECT '<s>', 0.1::DOUBLE")
def zerogram(spark, d):
    words = _lexicon(spark, d).select("word").union(spark.createDataFrame([("<s>",)], "word string"))
    return lx.zerogram(words, {"<s>": 0.1}).withColumn("p", F.round("p", 9))


_NGRAM_SQL = f"""{_WORDS_SQL}, o AS (SELECT w, count(*) AS c FROM (SELECT unnest(words) AS w FROM t) GROUP BY w), u AS (SELECT w, c / sum(c) OVER () AS p FROM o),
b AS (SELECT words[k] AS a, words[k + 1] AS b, count(*) AS c FROM t, LATERAL unnest(generate_series(1, len(words) - 1)) AS q(k) GROUP BY 1, 2),
p2 AS (SELECT a, b, (c - 0.5::DOUBLE) / sum(c) OVER (PARTITION BY a) AS p FROM b),
bo AS (SELECT a AS w, (1 - sum(p2.p)) / nullif(1 - sum(u.p), 0) AS backoff FROM p2 JOIN u ON u.w = p2.b GROUP BY a)"""


@query(f"WITH {_NGRAM_SQL} SELECT 1 AS n, w AS w1, '' AS w2, round(p, 8) AS p, round(backoff, 9) AS backoff FROM u LEFT JOIN bo USING (w) UNION ALL SELECT 2, a, b, round(p, 8), NULL FROM p2")
def ngram_estimate(spark, d):
    g = lx.estimate_ngrams(_turns(spark, d))
    return g.select("n", F.col("words")[0].alias("w1"), F.coalesce(F.get("words", F.lit(1)), F.lit("")).alias("w2"), F.round("p", 8).alias("p"), F.round("backoff", 9).alias("backoff"))


@query(f"WITH {_NGRAM_SQL}, {_LEX_SQL}, l AS (SELECT word, coalesce(p, 0.001::DOUBLE) AS p FROM x LEFT JOIN u ON u.w = x.word) SELECT word, round(p * 0.9::DOUBLE / sum(p) OVER (), 8) AS p FROM l")
def unigram_rescale(spark, d):
    return lx.unigram(_lexicon(spark, d), lx.estimate_ngrams(_turns(spark, d)), {"<s>": 0.1}).withColumn("p", F.round("p", 8))


# All neighbours in the user's turns, and each word before and behind the words of the lexicon's order next to it: pairs that were seen, and pairs that need the back-off.
_PAIRS_SQL = f"""{_NGRAM_SQL}, {_LEX_SQL}, nx AS (SELECT word AS w1, lead(word) OVER (ORDER BY word) AS w2 FROM x),
q AS (SELECT DISTINCT a AS w1, b AS w2 FROM b UNION SELECT w1, w2 FROM nx WHERE w2 IS NOT NULL)"""


@query(f"""WITH {_PAIRS_SQL} SELECT w1, w2, round(coalesce(p2.p, coalesce(backoff, 1) * coalesce(u.p, 0.001::DOUBLE)), 9) AS p FROM q LEFT JOIN p2 ON p2.a = w1 AND p2.b = w2 LEFT JOIN bo ON bo.w = w1 LEFT JOIN u ON u.w = w2""")
def bigram_backoff(spark, d):
    turns = _turns(spark, d)
    neighbours = lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    seen = turns.select(F.explode(neighbours(F.col("words"))).alias("q")).select("q.*").filter("w2 IS NOT NULL")
    unseen = lx.next_words(_lexicon(spark, d)).select(F.col("word").alias("w1"), F.col("next").alias("w2")).filter("w2 IS NOT NULL")
    ngrams = lx.estimate_ngrams(turns).persist()
    return lx.bigram(seen.union(unseen).distinct(), ngrams).withColumn("p", F.round("p", 9))


_CTX_SQL = f"""{_LEX_SQL}, p AS (SELECT word, tokens, k - 1 AS pos, tokens[k] AS token FROM x, LATERAL unnest(generate_series(1, len(tokens))) AS q(k)),
c AS (SELECT word, pos, token, array_to_string(list_slice(tokens, pos - l + 1, pos), ' ') AS lft, array_to_string(list_slice(tokens, pos + 2, pos + 1 + r), ' ') AS rgt, l, r
  FROM p, (VALUES (0, 0), (1, 0), (1, 1)) AS s(r, l) WHERE pos >= l AND pos + r < len(tokens))"""


@query(f"WITH {_CTX_SQL} SELECT word, CAST(pos AS INTEGER) AS pos, lft || '/' || token || '/' || rgt AS context FROM c")
def token_contexts(spark, d):
    seq = _lexicon(spark, d).select(F.col("word").alias("utt_id"), "tokens")
    rows = lx.token_contexts(seq, 2)
    return rows.select(F.col("utt_id").alias("word"), "pos", lx.context_name(F.col("left"), F.col("token"), F.col("right")).alias("context"))


@query(f"WITH {_CTX_SQL} SELECT lft || '/' || token || '/' || rgt AS context, count(*) AS n FROM c GROUP BY lft, token, rgt, l, r HAVING count(*) >= 20 OR (l = 0 AND r = 0)")
def occurrence_prune(spark, d):
    seq = _lexicon(spark, d).select(F.col("word").alias("utt_id"), "tokens")
    rows = lx.prune_contexts(lx.token_contexts(seq, 2), 20)
    return rows.select(lx.context_name(F.col("left"), F.col("token"), F.col("right")).alias("context"), "n")


@query(f"""WITH {_CTX_SQL}, k AS (SELECT lft, token, rgt, l, r FROM c GROUP BY ALL HAVING count(*) >= 20 OR (l = 0 AND r = 0)),
m AS (SELECT c.*, row_number() OVER (PARTITION BY word, pos ORDER BY c.l + c.r DESC, c.r DESC) AS q FROM c JOIN k USING (lft, token, rgt, l, r))
SELECT word, CAST(pos AS INTEGER) AS pos, lft || '/' || token || '/' || rgt AS context FROM m WHERE q = 1""")
def polyphone_match(spark, d):
    seq = _lexicon(spark, d).select(F.col("word").alias("utt_id"), "tokens")
    contexts = lx.token_contexts(seq, 2)
    rows = lx.longest_match(contexts, lx.prune_contexts(contexts, 20))
    return rows.select(F.col("utt_id").alias("word"), "pos", lx.context_name(F.col("left"), F.col("token"), F.col("right")).alias("context"))


def _models():
    b = np.array([[0.5, 0.2, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]])
    return {t: hmm.Hmm(np.array([1.0, 0]), hmm.topology(2, "LINEAR"), symbols=np.roll(b, i, axis=1)) for i, t in enumerate("abc")}


_WORDS = {"ab": ["a", "b"], "cab": ["c", "a", "b"], "ba": ["b", "a"]}


def _symbols(spark, d):
    from strideframe.plans.model_queries import _discrete

    return _discrete(spark, d)


def _decode_sql(follow: dict, penalty: float) -> str:
    """Exact search over (word before, word, token, state): these are fewer than the beam, so that it cuts nothing."""
    models = _models()
    number = {(b, w, k, s): i for i, (b, w, k, s) in enumerate((b, w, k, s) for b, ps in follow.items() for w in ps for k in range(len(_WORDS[w])) for s in (0, 1))}
    edges, starts, ends, emits = [], [], [], []
    for (b, w, k, s), i in number.items():
        edges += [(i, number[b, w, k, to], f"ln({models[_WORDS[w][k]].a[s, to]}::DOUBLE)", "''") for to in (0, 1) if models[_WORDS[w][k]].a[s, to] > 0]
        if s == 1 and k + 1 < len(_WORDS[w]):
            edges.append((i, number[b, w, k + 1, 0], "0.0::DOUBLE", "''"))
        elif s == 1:
            ends.append((i, w))
            edges += [(i, number[w, v, 0, 0], f"ln({penalty}::DOUBLE) + ln({p!r}::DOUBLE)", f"'{w} '") for v, p in follow.get(w, {}).items()]
        if b is None and k == 0 and s == 0:
            starts.append((i, f"ln({follow[None][w]!r}::DOUBLE)"))
        emits += [(i, o, f"ln({float(v)!r}::DOUBLE)") for o, v in enumerate(models[_WORDS[w][k]].symbols[s])]
    rows = lambda values: ", ".join("(" + ", ".join(map(str, v)) + ")" for v in values)
    return f"""WITH RECURSIVE {_D_SQL}, g(i, j, c, said) AS (VALUES {rows(edges)}), st(j, c) AS (VALUES {rows(starts)}), en(j, w) AS (VALUES {rows((i, repr(w)) for i, w in ends)}), em(j, o, lb) AS (VALUES {rows(emits)}),
f(utt_id, t, j, s, h) AS (SELECT utt_id, t, j, c + lb, '' FROM x JOIN em USING (o) JOIN st USING (j) WHERE t = 0
  UNION ALL SELECT x.utt_id, x.t, m.j, m.s + lb, m.h FROM (SELECT utt_id, t + 1 AS t, g.j, max(s + c) AS s, arg_max(h || said, s + c) AS h FROM f JOIN g ON g.i = f.j GROUP BY utt_id, t, g.j) m JOIN x USING (utt_id, t) JOIN em ON em.j = m.j AND em.o = x.o),
e2 AS (SELECT f.utt_id, h || w AS words, max(s) + ln({penalty}::DOUBLE) AS score FROM f JOIN x USING (utt_id, t) JOIN en USING (j) WHERE t = n - 1 GROUP BY 1, 2)
SELECT utt_id, 1 AS rank, first(words ORDER BY score DESC, words) AS words, round(max(score), 4) AS score FROM e2 GROUP BY utt_id"""


_EVEN = {w: 1 / 3 for w in _WORDS}
_FOLLOW = {None: _EVEN, "ab": {"ab": 0.2, "cab": 0.5, "ba": 0.3}, "cab": _EVEN, "ba": _EVEN}


@query(_decode_sql(_FOLLOW, 0.5))
def beam_decode(spark, d):
    rows = dc.decode(_symbols(spark, d), _WORDS, _models(), _FOLLOW, beam=60, width=200.0, penalty=0.5)
    return rows.select("utt_id", "rank", F.array_join("words", " ").alias("words"), F.round("score", 4).alias("score"))


@query(_decode_sql(dc.fixed_sequences([["ab", "cab", "ba"]]), 1.0))
def fixed_sequence_align(spark, d):
    rows = dc.decode(_symbols(spark, d), _WORDS, _models(), dc.fixed_sequences([["ab", "cab", "ba"]]), beam=60)
    return rows.select("utt_id", "rank", F.array_join("words", " ").alias("words"), F.round("score", 4).alias("score"))


@query("""WITH c AS (SELECT conv_id, turn, text, rtrim(text, chr(32)) AS r FROM conversations)
SELECT conv_id, turn, CASE WHEN ends_with(r, '!!') THEN 'EXCLAMATION' WHEN ends_with(r, '!') THEN 'COMMAND' WHEN ends_with(r, '?') THEN 'QUESTION' ELSE 'STATEMENT' END AS mood FROM c""")
def mood(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", an.mood(F.col("text")).alias("mood"))


@query("""WITH c AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda q: q <> '') AS w FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n, CASE WHEN len(w) > 4 THEN substr(text, 1, length(array_to_string(list_slice(regexp_extract_all(text, '[^ \\n]+[ \\n]*'), 1, 4), ''))) ELSE text END AS head
FROM c""")
def utterance_slice(spark, d):
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    rows = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text", words.alias("w"))
    rows = rows.withColumn("starts", an.word_starts(F.col("text"), F.col("w")))
    return rows.select("conv_id", "turn", F.size("w").alias("n"), an.slice_words(F.col("text"), F.col("starts"), 0, 4).alias("head"))


@query(f"""WITH {E_SQL}, t AS (SELECT utt_id, frame_idx AS entry_idx, event_type AS word, frame_idx * 100 AS s, frame_idx * 100 + CAST(trunc(v * 4) AS BIGINT) AS e FROM e),
o AS (SELECT *, lag(e) OVER (PARTITION BY utt_id ORDER BY s, entry_idx) AS b FROM t) SELECT utt_id, entry_idx, word, s AS start_sample, e AS end_sample FROM o WHERE b > s""")
def transcription_overlap(spark, d):
    return an.overlaps(_entries(spark, d))


def _entries(spark, d):
    start = F.col("frame_idx") * 100
    return events(spark, d, "event_type").select("utt_id", F.col("frame_idx").alias("entry_idx"), F.col("event_type").alias("word"), start.alias("start_sample"), (start + (F.col("x")[0] * 4).cast("long")).alias("end_sample"))


@query(f"""WITH {E_SQL}, t AS (SELECT utt_id, frame_idx AS entry_idx, event_type AS word, frame_idx * 100 AS s, frame_idx * 100 + CAST(trunc(v * 4) AS BIGINT) AS e FROM e)
SELECT utt_id, entry_idx, word, s AS start_sample, coalesce(lead(s) OVER (PARTITION BY utt_id ORDER BY entry_idx), e) AS end_sample FROM t""")
def transcription_connect(spark, d):
    return an.connect(_entries(spark, d))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || '_' || page_id || '_' || (page_id + 500) || '.wav' AS file, page_id AS start_ms, page_id + 500 AS end_ms, 'hello there' AS text FROM pages""")
def turn_parse(spark, d):
    name = F.concat(F.regexp_extract("url", "([^/]*)$", 1), F.lit("_"), F.col("page_id"), F.lit("_"), F.col("page_id") + 500, F.lit(".wav hello there"))
    return table(spark, d, "pages").select("page_id", *an.turn_fields(name))


@query("SELECT url AS name FROM pages WHERE url >= 'https://m' ORDER BY url LIMIT 1")
def turn_search(spark, d):
    return an.find_turn(table(spark, d, "pages").select(F.col("url").alias("name")), "https://m")


@query()
def syllable_nuclei(spark, d):
    bands = vectors(spark, d).select("utt_id", "frame_idx", F.transform(F.slice("x", 1, 3), F.abs).alias("x"))
    rows = sy.nucleus_features(sy.syllable_nuclei(bands), 100.0, 160)
    flat = ("tempo", "seconds", "duration_contrast", "max_contrast", "sum_contrast", "max_energy", "sum_energy")
    return rows.select("utt_id", "nucleus", "start_min", "start", "peak", "stop", "stop_min", "band", *[F.round(c, 6).alias(c) for c in flat])


@query(f"WITH {V_SQL} SELECT utt_id, count(*) AS n FROM vv GROUP BY utt_id")
def utterance_counts(spark, d):
    return vectors(spark, d).groupBy("utt_id").agg(F.count("*").alias("n"))


# Nodes in the order of their paths, the end of a word behind its node and before longer ones; all words have equal mass.
@query(f"""WITH {_LEX_SQL}, pf AS (SELECT word, list_slice(tokens, 1, k) AS path, len(tokens) AS n FROM x, LATERAL unnest(generate_series(0, len(tokens))) AS u(k)),
nd AS (SELECT path, count(*) AS m FROM pf GROUP BY path),
al AS (SELECT nd.path, CAST(NULL AS VARCHAR) AS word, nd.m, up.m AS above FROM nd LEFT JOIN nd up ON len(nd.path) > 0 AND up.path = list_slice(nd.path, 1, len(nd.path) - 1)
  UNION ALL SELECT x.tokens, word, 1, nd.m FROM x JOIN nd ON nd.path = x.tokens)
SELECT CAST(row_number() OVER (ORDER BY path, word IS NOT NULL, word) - 1 AS INTEGER) AS i, CASE WHEN word IS NULL AND len(path) > 0 THEN path[len(path)] ELSE '' END AS token, coalesce(word, '') AS word,
  round(coalesce(ln(m) - ln(above), 0), 6) + 0.0 AS f FROM al""")
def lexical_tree(spark, d):
    words = _lexicon(spark, d)
    tree = lx.lexical_tree(words, lx.zerogram(words, {}))
    return tree.select("i", F.coalesce("token", F.lit("")).alias("token"), F.coalesce("word", F.lit("")).alias("word"), (F.round("f", 6) + F.lit(0.0)).alias("f"))


# Contexts of all words' tokens as a tree: 0/0, then one to the right, then one on both sides.
_TREE_SQL = f"""{_CTX_SQL}, nodes AS (SELECT lft || '/' || token || '/' || rgt AS uid, lft, token, rgt, l, r, count(*) AS n FROM c GROUP BY lft, token, rgt, l, r),
tree AS (SELECT uid, CASE WHEN l = 1 THEN '/' || token || '/' || rgt WHEN r = 1 THEN '/' || token || '/' END AS parent, l, r, n FROM nodes)"""


def _tree(spark, d):
    """Linked nodes with their number of places."""
    seq = _lexicon(spark, d).select(F.col("word").alias("utt_id"), "tokens")
    nodes = lx.token_contexts(seq, 2).groupBy("left", "token", "right").agg(F.count("*").alias("n"))
    return hy.link(nodes)


@query(f"WITH {_TREE_SQL} SELECT uid, parent, n FROM tree")
def token_hierarchy(spark, d):
    return _tree(spark, d).select("uid", "parent", "n")


@query(f"""WITH {_TREE_SQL}, one AS (SELECT min(uid) AS uid, parent FROM tree WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) = 1)
SELECT t.uid, coalesce(b.parent, a.parent, t.parent) AS parent FROM tree t LEFT JOIN one a ON a.uid = t.parent LEFT JOIN one b ON b.uid = a.parent WHERE t.uid NOT IN (SELECT uid FROM one)""")
def hierarchy_pruned(spark, d):
    return hy.prune_single(_tree(spark, d), 2).select("uid", "parent")


@query(f"WITH {_TREE_SQL} SELECT uid, parent FROM tree WHERE parent IS NULL OR l = 0 AND r = 0")
def hierarchy_reduced(spark, d):
    return hy.reduce_context(_tree(spark, d), 0).select("uid", "parent")


_MASS_SQL = f"{_TREE_SQL}, m2 AS (SELECT parent AS uid, sum(n) AS n FROM tree WHERE l = 1 GROUP BY parent), m1 AS (SELECT t.uid, t.parent, t.l, t.r, t.n + coalesce(m2.n, 0) AS n FROM tree t LEFT JOIN m2 USING (uid)), m0 AS (SELECT parent AS uid, sum(n) AS n FROM m1 WHERE l = 0 AND r = 1 GROUP BY parent), mass AS (SELECT m1.uid, m1.parent, m1.l, m1.r, CAST(m1.n + coalesce(CASE WHEN m1.r = 0 THEN m0.n END, 0) AS BIGINT) AS n FROM m1 LEFT JOIN m0 USING (uid))"


@query(f"WITH {_MASS_SQL} SELECT uid, n FROM mass")
def hierarchy_counts(spark, d):
    tree = _tree(spark, d)
    return hy.propagate(tree, tree.select("uid", "n"), 2)


@query(f"WITH {_MASS_SQL} SELECT uid FROM mass WHERE parent IS NULL OR n >= 20")
def hierarchy_frequent(spark, d):
    tree = _tree(spark, d)
    return hy.prune_rare(tree.drop("n"), hy.propagate(tree, tree.select("uid", "n"), 2), 20).select("uid")


@query(f"""WITH {_TREE_SQL}, v0 AS (SELECT uid, n::DOUBLE AS v FROM tree WHERE parent IS NULL), v1 AS (SELECT t.uid, 30 / (30.0::DOUBLE + n) * v0.v + (1 - 30 / (30.0::DOUBLE + n)) * n AS v FROM tree t JOIN v0 ON v0.uid = t.parent),
v2 AS (SELECT t.uid, 30 / (30.0::DOUBLE + n) * v1.v + (1 - 30 / (30.0::DOUBLE + n)) * n AS v FROM tree t JOIN v1 ON v1.uid = t.parent) SELECT uid, round(v, 5) AS v FROM (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2)""")
def hierarchy_interpolated(spark, d):
    tree = _tree(spark, d)
    stats = tree.select("uid", F.col("n").alias("mass"), F.col("n").cast("double").alias("v"))
    return hy.interpolate(tree, stats, 30.0, 2).withColumn("v", F.round("v", 5))


@query(f"""WITH {_TREE_SQL}, pth AS (SELECT t.uid, list_filter([b.uid, a.uid, t.uid], lambda q: q IS NOT NULL) AS path FROM tree t LEFT JOIN tree a ON a.uid = t.parent LEFT JOIN tree b ON b.uid = a.parent)
SELECT row_number() OVER (ORDER BY path) - 1 AS place, uid, CAST(len(path) - 1 AS INTEGER) AS depth FROM pth""")
def hierarchy_walk(spark, d):
    return hy.traverse(_tree(spark, d), 2)


@query(f"WITH {_LEX_SQL} SELECT row_number() OVER (ORDER BY word) - 1 AS place, word FROM x")
def lexicon_sorted(spark, d):
    return lx.sorted_lexicon(_lexicon(spark, d)).select("place", "word")


@query(f"""WITH {E_SQL}, t AS (SELECT utt_id, frame_idx AS entry_idx, event_type AS word, frame_idx * 100 AS s, CASE WHEN v > 20 THEN frame_idx * 100 + 99 ELSE frame_idx * 100 + 50 END AS e FROM e)
SELECT utt_id, entry_idx, word, s AS start_sample, CASE WHEN lead(s) OVER (PARTITION BY utt_id ORDER BY entry_idx) = e + 1 THEN e - 1 ELSE e END AS end_sample FROM t""")
def transcription_disconnect(spark, d):
    start = F.col("frame_idx") * 100
    rows = events(spark, d, "event_type").select(
        "utt_id", F.col("frame_idx").alias("entry_idx"), F.col("event_type").alias("word"), start.alias("start_sample"), (start + F.when(F.col("x")[0] > 20, 99).otherwise(50)).alias("end_sample"),
    )
    return an.disconnect(rows)


_SAID = """c AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda q: q <> '') AS w FROM conversations)"""


def _said(spark, d):
    """Utterances with a boundary before their third word and subdivisions at the first and the fourth."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("orthography"), words.alias("w"))
    return rows.select(
        "conv_id", "turn", "orthography", F.transform("w", lambda w: F.struct(w.alias("graphemes"))).alias("words"),
        F.array(F.struct(F.lit(2).alias("index"), F.lit("B3").alias("type"))).alias("boundaries"), F.array(F.struct(F.lit(0).alias("index")), F.struct(F.lit(3).alias("index"))).alias("subdivisions"),
    )


@query(f"WITH {_SAID} SELECT conv_id, turn, array_to_string(list_slice(w, 1, 2) || CASE WHEN len(w) > 2 THEN ['B3'] ELSE [] END || list_slice(w, 3, len(w)), ' ') AS rendered FROM c")
def utterance_text(spark, d):
    return _said(spark, d).select("conv_id", "turn", an.render_text(F.col("words"), F.col("boundaries")).alias("rendered"))


@query(f"WITH {_SAID} SELECT conv_id, turn, CAST(len(w) - 3 AS INTEGER) AS n, w[4] AS head FROM c WHERE len(w) > 3")
def utterance_part(spark, d):
    """The words from the second subdivision on."""
    cut = an.subdivision_bounds(_said(spark, d).filter("size(words) > 3"), 1, 1)
    words = F.slice("words", F.col("first") + 1, F.col("after") - F.col("first"))
    return cut.select("conv_id", "turn", F.size(words).alias("n"), words[0]["graphemes"].alias("head"))


@query(f"WITH {_SAID} SELECT conv_id, turn, len(w) < 3 AS same FROM c")
def utterance_equality(spark, d):
    """Whether an utterance equals itself without its boundaries: what their documents say."""
    u = _said(spark, d)
    shown = F.filter("boundaries", lambda b: b["index"] < F.size("words"))
    return u.select("conv_id", "turn", an.same_document(F.struct("orthography", "words", shown.alias("boundaries")), F.struct("orthography", "words", F.filter("boundaries", lambda b: F.lit(False)).alias("boundaries"))).alias("same"))

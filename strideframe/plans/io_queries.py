"""Catalogue: files. Each query sends a table through a sink to the shared folder and reads it back through a source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strideframe.functions.labels import ALPHABET, id_to_label, label_to_id
from strideframe.operators import context as cx, frames as fr, gaussians as gm, hmm
from strideframe.plans.common import E_SQL, L_SQL, V_SQL, events, lines, vectors
from strideframe.plans.text_queries import _LEX_SQL, _NGRAM_SQL, _WORDS_SQL, _entries, _lexicon, _turns
from strideframe.session import scratch_path, table
from strideframe.operators import lexicon as lx
from strideframe.sources import binary as bn, models as md, stored as st, text as tx

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _stored(spark, files, name: str, suffix: str = "") -> str:
    path = scratch_path(spark, name)
    bn.write_files(files, path, suffix)
    return path


def _as_text(spark, lines_df, name: str) -> str:
    path = scratch_path(spark, name)
    lines_df.select("value").write.text(path)
    return path


def _number(rows, suffix: str = ""):
    """Files are named by their utterance's number."""
    return rows.withColumn("utt_id", F.replace("utt_id", F.lit(suffix), F.lit("")).cast("long") if suffix else F.col("utt_id").cast("long"))


def _one_file(rows, encode, *columns: str):
    """(utt_id, content) of a whole small table, made by one task."""
    run = lambda pdf: pd.DataFrame({"utt_id": ["all"], "content": [encode(pdf)]})
    return rows.select(*columns, F.lit("all").alias("_g")).groupBy("_g").applyInPandas(run, "utt_id string, content binary")


_LONG = f"WITH {L_SQL} SELECT utt_id, frame_idx, CAST(dim AS INTEGER) AS dim, round({{}}, {{}}) + 0.0 AS v FROM ll"


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) + 0.0 AS v FROM e")
def frame_files(spark, d):
    path = _stored(spark, bn.to_files(events(spark, d)), "frames")
    return _number(bn.read_frames(spark, path)).select("utt_id", "frame_idx", (F.round(F.col("x")[0], 4) + F.lit(0.0)).alias("v"))


@query(_LONG.format("v", 4))
def frame_files_double(spark, d):
    path = _stored(spark, bn.to_files(lines(spark, d), double=True), "frames")
    return fr.long_form(_number(bn.read_frames(spark, path, double=True)), digits=4)


@query(_LONG.format("CAST(CAST(v AS FLOAT) AS DOUBLE)", 4))
def headerless_files(spark, d):
    path = _stored(spark, bn.to_files(lines(spark, d), header=False), "frames")
    return fr.long_form(_number(bn.read_frames(spark, path, width=4)), digits=4)


@query(_LONG.format("v", 4))
def text_frame_files(spark, d):
    path = _stored(spark, bn.pack_files(lines(spark, d), "x", bn.encode_text_frames), "frames")
    return fr.long_form(_number(bn.read_text_frames(spark, path)), digits=4)


@query(_LONG.format("v", 4))
def csv_frame_files(spark, d):
    files = bn.pack_files(lines(spark, d), "x", lambda x: bn.encode_text_frames(x, ",", ["line items", "quantity,price,discount,tax"]))
    return fr.long_form(_number(bn.read_text_frames(spark, _stored(spark, files, "frames"))), digits=4)


@query(_LONG.format("v", 4))
def text_sink(spark, d):
    path = scratch_path(spark, "frames")
    bn.write_text_frames(lines(spark, d), path)
    # Each utterance is one file; its lines are numbered by their place in it.
    whole = spark.read.text(path, wholetext=True).select(F.col("utt_id").cast("long").alias("utt_id"), F.posexplode(F.filter(F.split("value", "\n"), lambda r: r != "")).alias("frame_idx", "line"))
    x = F.transform(F.split("line", " "), lambda v: v.cast("double"))
    return fr.long_form(whole.select("utt_id", F.col("frame_idx").cast("long").alias("frame_idx"), x.alias("x")), digits=4)


def _labelled(spark, d):
    code = F.when(F.col("c") == "A", 0).when(F.col("c") == "N", 1).otherwise(2).cast("short")
    return lines(spark, d).select("utt_id", "frame_idx", code.alias("c"), (F.col("frame_idx") % 7).cast("short").alias("y"), "x")


_LABELLED_SQL = f"WITH {L_SQL} SELECT utt_id, frame_idx, CAST(CASE c WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS SMALLINT) AS c, CAST(frame_idx % 7 AS SMALLINT) AS y, CAST(dim AS INTEGER) AS dim, round({{}}, 4) + 0.0 AS v FROM ll"


@query(_LABELLED_SQL.format("CAST(CAST(v AS FLOAT) AS DOUBLE)"))
def sample_files(spark, d):
    path = _stored(spark, bn.to_sample_files(_labelled(spark, d)), "samples")
    return fr.long_form(_number(bn.read_samples(spark, path)), "c", "y", digits=4)


@query(_LABELLED_SQL.format("v"))
def text_sample_files(spark, d):
    rows = _labelled(spark, d).withColumn("x", F.concat(F.array(F.col("c").cast("double"), F.col("y").cast("double")), "x"))
    path = _stored(spark, bn.pack_files(rows, "x", bn.encode_text_frames), "samples")
    return fr.long_form(_number(bn.read_text_samples(spark, path)), "c", "y", digits=4)


_KIND = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'login' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


def _kinds(spark, d):
    number = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "login", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    return events(spark, d, "event_type").select("utt_id", "frame_idx", "x", number.alias("label"))


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, {_KIND} AS label FROM e")
def label_files(spark, d):
    path = _stored(spark, bn.pack_files(_kinds(spark, d), "label", bn.encode_labels), "labels")
    return _number(bn.read_labels(spark, path))


@query(f"WITH {E_SQL} SELECT utt_id, frame_idx, round(v, 4) + 0.0 AS v FROM e WHERE {_KIND} < 2")
def decision_files(spark, d):
    """Frames by 0/1 decisions from files."""
    rows = _kinds(spark, d)
    path = _stored(spark, bn.pack_files(rows.withColumn("label", (F.col("label") < 2).cast("int")), "label", bn.encode_labels), "decisions")
    kept = fr.vad_filter(rows.select("utt_id", "frame_idx", "x"), _number(bn.read_labels(spark, path)).withColumnRenamed("label", "keep"))
    return kept.select("utt_id", "frame_idx", (F.round(F.col("x")[0], 4) + F.lit(0.0)).alias("v"))


def _listed(spark, d):
    """A list file of every second user, latest first, with the first events as words."""
    rows = events(spark, d, "event_type")
    said = rows.filter("frame_idx < 3").groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "event_type"))).alias("s")).filter("utt_id % 2 = 0")
    line = said.select("utt_id", F.concat_ws(" ", F.col("utt_id").cast("string"), F.array_join(F.transform("s", lambda e: e["event_type"]), " ")).alias("line"))
    packed = _one_file(line, lambda pdf: "\n".join(pdf.sort_values("utt_id", ascending=False)["line"]).encode(), "utt_id", "line")
    return tx.read_list(spark, _stored(spark, packed, "list"))


_LISTED_SQL = f"{E_SQL}, li AS (SELECT CAST(row_number() OVER (ORDER BY utt_id DESC) - 1 AS INTEGER) AS pos, utt_id, string_agg(event_type, ' ' ORDER BY frame_idx) AS words FROM e WHERE frame_idx < 3 AND utt_id % 2 = 0 GROUP BY utt_id)"


@query(f"WITH {_LISTED_SQL} SELECT pos, utt_id, words FROM li")
def transcribed_list(spark, d):
    return _number(_listed(spark, d)).select("pos", "utt_id", F.array_join("words", " ").alias("words"))


@query(f"WITH {_LISTED_SQL} SELECT pos, utt_id, frame_idx, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) + 0.0 AS v FROM li JOIN e USING (utt_id)")
def listed_frames(spark, d):
    path = _stored(spark, bn.to_files(events(spark, d)), "frames")
    rows = bn.by_list(bn.read_frames(spark, path), _listed(spark, d).select("pos", "utt_id"))
    return _number(rows).select("pos", "utt_id", "frame_idx", (F.round(F.col("x")[0], 4) + F.lit(0.0)).alias("v"))


def _wav(spark, d):
    files = bn.pack_files(events(spark, d), "x", lambda x: bn.to_wav(x[:, 0] / 300, 16000))
    return bn.read_audio(spark, _stored(spark, files, "audio", ".wav"), "t:wav/16")


_PCM = "round(greatest(-1, least(1, v / 300)) * 32767) / 32767"


@query(f"WITH {E_SQL} SELECT utt_id, 16000 AS sample_rate, CAST(frame_idx AS INTEGER) AS n, round({_PCM}, 6) + 0.0 AS v FROM e")
def wav_files(spark, d):
    rows = _number(_wav(spark, d), ".wav").select("utt_id", "sample_rate", F.posexplode("samples").alias("n", "v"))
    return rows.withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(f"""WITH {_LISTED_SQL}, n AS (SELECT utt_id, pos, count(*) AS n FROM e JOIN li USING (utt_id) GROUP BY utt_id, pos), f AS (SELECT utt_id, n, coalesce(sum((n + 15) // 16) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n)
SELECT CAST(first + frame_idx // 16 AS BIGINT) AS block_idx, 16 AS width, round(sum({_PCM}), 5) + 0.0 AS total FROM e JOIN f USING (utt_id) GROUP BY first + frame_idx // 16""")
def audio_list(spark, d):
    entries = _listed(spark, d).select("pos", F.concat("utt_id", F.lit(".wav")).alias("utt_id"))
    blocks = bn.list_audio(_wav(spark, d).select("utt_id", "samples"), entries, 16)
    return blocks.select("block_idx", F.size("samples").alias("width"), (F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 5) + F.lit(0.0)).alias("total"))


def _compressed(name: str, law: str):
    """Bytes that the documents' ids give, by language, read as compressed audio."""
    def run(spark, d):
        rows = table(spark, d, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("utt_id"), F.col("doc_id").alias("frame_idx"), (F.col("doc_id") % 256).alias("b"))
        path = _stored(spark, bn.pack_files(rows, "b", lambda b: b.astype(np.uint8).tobytes()), name)
        return bn.read_audio(spark, path, f"t:{law}/8").select("utt_id", "sample_rate", F.posexplode("samples").alias("n", "v")).withColumn("v", F.round("v", 6) + F.lit(0.0))
    run.__name__ = name
    return run


_BYTES = "b AS (SELECT lang AS utt_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER) AS n, CAST(doc_id % 256 AS INTEGER) AS b FROM documents WHERE lang IS NOT NULL)"
query(f"""WITH {_BYTES}, u AS (SELECT *, 255 - b AS u FROM b), m AS (SELECT *, ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132 AS m FROM u)
SELECT utt_id, 8000 AS sample_rate, n, round(greatest(-1, least(1, CASE WHEN u & 128 > 0 THEN -m ELSE m END / 32767::DOUBLE)), 6) + 0.0 AS v FROM m""")(_compressed("ulaw_files", "ulaw"))
query(f"""WITH {_BYTES}, u AS (SELECT *, xor(b, 85) AS a FROM b), m AS (SELECT *, CASE WHEN (a >> 4) & 7 = 0 THEN ((a & 15) << 4) + 8 ELSE (((a & 15) << 4) + 264) << (((a >> 4) & 7) - 1) END AS m FROM u)
SELECT utt_id, 8000 AS sample_rate, n, round(greatest(-1, least(1, CASE WHEN a & 128 > 0 THEN m ELSE -m END / 32767::DOUBLE)), 6) + 0.0 AS v FROM m""")(_compressed("alaw_files", "alaw"))


@query(f"""WITH {E_SQL}, p AS (SELECT utt_id, frame_idx, round(greatest(-1, least(1, v / 300)) * 32767) AS q FROM e), c AS (SELECT utt_id, frame_idx, q - avg(q) OVER (PARTITION BY utt_id) AS q FROM p)
SELECT utt_id, CAST(frame_idx AS INTEGER) AS n, round(q / max(abs(q)) OVER (PARTITION BY utt_id) * 32767) / 32767 AS v FROM c""")
def normalised_pcm(spark, d):
    files = bn.pack_files(events(spark, d), "x", lambda x: bn.normalize_pcm16(bn.to_pcm16(x[:, 0] / 300), remove_dc=True))
    rows = bn.read_audio(spark, _stored(spark, files, "pcm"), "t:ssg/16")
    return _number(rows).select("utt_id", F.posexplode("samples").alias("n", "v"))


@query(f"WITH {_WORDS_SQL} SELECT utt_id, array_to_string(words, ' ') AS words FROM t WHERE len(words) > 0")
def turn_list(spark, d):
    rows = _turns(spark, d).filter("size(words) > 0").select(F.concat_ws(" ", F.col("utt_id").cast("string"), F.array_join("words", " ")).alias("value"))
    return _number(tx.read_turns(spark, _as_text(spark, rows, "turns"))).select("utt_id", F.array_join("words", " ").alias("words"))


@query("SELECT DISTINCT user_id AS utt_id, event_type AS model_id FROM events")
def trial_list(spark, d):
    rows = events(spark, d, "event_type").select(F.concat_ws(" ", "event_type", F.col("utt_id").cast("string")).alias("value")).distinct()
    return _number(tx.read_trials(spark, _as_text(spark, rows, "trials")))


@query(f"WITH {_LEX_SQL} SELECT word, array_to_string(tokens, ' ') AS tokens FROM x")
def lexicon_file(spark, d):
    rows = _lexicon(spark, d).select(F.concat_ws(" ", "word", F.array_join("tokens", " ")).alias("value"))
    return tx.read_lexicon(spark, _as_text(spark, rows, "lexicon")).select("word", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT event_type AS token, CAST(count(*) % 5 + 1 AS SMALLINT) AS n_states FROM events GROUP BY event_type")
def alphabet_file(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").count().select(F.concat_ws(" ", "event_type", (F.col("count") % 5 + 1).cast("string")).alias("value"))
    comment = spark.createDataFrame([("; token states",), ("",)], "value string")
    return tx.read_alphabet(spark, _as_text(spark, rows.union(comment), "alphabet"))


@query("""WITH l AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS subject_id, quality, toxic FROM labels)
SELECT subject_id, '0' AS rater_id, CASE WHEN quality = 1 THEN quality::DOUBLE END AS rating FROM l UNION ALL SELECT subject_id, '1', toxic::DOUBLE FROM l""")
def ratings_file(spark, d):
    cell = lambda c: F.coalesce(c.cast("string"), F.lit("nan"))
    rows = table(spark, d, "labels").select("doc_id", F.concat_ws(" ", cell(F.when(F.col("quality") == 1, F.col("quality"))), cell(F.col("toxic"))).alias("line"))
    packed = _one_file(rows, lambda pdf: "\n".join(pdf.sort_values("doc_id")["line"]).encode(), "doc_id", "line")
    return tx.read_ratings(spark, _stored(spark, packed, "ratings"))


@query(f"WITH {E_SQL} SELECT utt_id, CAST(frame_idx AS INTEGER) AS entry_idx, event_type AS word, frame_idx * 100 AS start_sample, frame_idx * 100 + CAST(trunc(v * 4) AS BIGINT) AS end_sample FROM e")
def transcription_file(spark, d):
    return _number(tx.read_transcriptions(spark, _as_text(spark, tx.transcription_lines(_entries(spark, d)), "transcription")))


@query(f"WITH {_NGRAM_SQL} SELECT 1 AS n, w AS words, round(p, 8) AS p, round(CASE WHEN backoff > 0 THEN backoff END, 8) AS backoff FROM u LEFT JOIN bo USING (w) UNION ALL SELECT 2, a || ' ' || b, round(p, 8), NULL FROM p2")
def arpa_file(spark, d):
    path = scratch_path(spark, "arpa")
    tx.write_arpa(lx.estimate_ngrams(_turns(spark, d)), path)
    back = tx.read_arpa(spark, path)
    return back.select("n", F.array_join("words", " ").alias("words"), F.round("p", 8).alias("p"), F.round(F.when(F.col("backoff") > 0, F.col("backoff")), 8).alias("backoff"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda q: q <> '') AS w FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS segment_id, CAST(turn AS VARCHAR) AS track, role, CAST(length(text) AS INTEGER) AS chars, CAST(len(w) AS INTEGER) AS n_words, w[len(w)] AS last_word, CAST(len(w) // 2 AS INTEGER) AS boundary, 'B3' AS kind,
  CAST(length(w[1]) AS INTEGER) AS phonemes, CASE WHEN length(w[1]) > 3 THEN 'PRIMARY' ELSE 'NONE' END AS stress FROM c WHERE len(w) > 0""")
def annotation_file(spark, d):
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("utt_id"), "turn", "role", "text", words.alias("w")).filter("size(w) > 0")

    def document(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        said = [{
            "role": r, "segment_id": key[0], "track": t, "orthography": x, "boundaries": [(len(w) // 2, "B3")], "subdivisions": [0],
            "words": [(g, "NONE", [(0, len(g), "PRIMARY" if len(g) > 3 else "NONE")], list(g)) for g in w],
        } for t, r, x, w in pdf.sort_values("turn")[["turn", "role", "text", "w"]].itertuples(index=False)]
        return pd.DataFrame({"utt_id": [str(key[0])], "content": [tx.annotation_xml(said).encode()]})

    files = rows.groupBy("utt_id").applyInPandas(document, "utt_id string, content binary")
    read = tx.read_annotations(spark, _stored(spark, files, "annotation", ".xml"))
    first = F.col("words")[0]
    return read.select(
        "segment_id", "track", "role", F.length("orthography").alias("chars"), F.size("words").alias("n_words"), F.element_at("words", -1)["graphemes"].alias("last_word"),
        F.col("boundaries")[0]["index"].alias("boundary"), F.col("boundaries")[0]["type"].alias("kind"), F.size(first["phonemes"]).alias("phonemes"), first["syllables"][0]["stress"].alias("stress"),
    )


@query(f"WITH {_LEX_SQL} SELECT word, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS INTEGER) AS n FROM x")
def configuration_file(spark, d):
    rows = _lexicon(spark, d).select("word", "tokens")
    encode = lambda pdf: md.configuration_xml({}, dict(zip(pdf["word"], map(list, pdf["tokens"]), strict=True))).encode()
    path = _stored(spark, _one_file(rows, encode, "word", "tokens"), "configuration")

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                lexicon = tx.read_configuration(bytes(content).decode())["lexicon"]
                yield pd.DataFrame({"word": list(lexicon), "tokens": [" ".join(t) for t in lexicon.values()], "n": [len(t) for t in lexicon.values()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word string, tokens string, n int")


_DIAG = f"WITH {V_SQL} SELECT c, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS mu, round(greatest(var_pop(v), 1e-10), 6) AS var FROM vl GROUP BY c, dim"


def _class_models(spark, d) -> dict[int, gm.Mixture]:
    """One Gaussian per label: a few labels, one small row each on the driver."""
    return {k[0]: gm._from_groups([s]) for k, s in gm.second_order(vectors(spark, d), "c").items()}


def _diagonals(spark, models: dict[int, gm.Mixture]):
    rows = [(c, i, round(float(m.means[0, i]), 6) + 0.0, round(float(m.covs[0, i]), 6)) for c, m in models.items() for i in range(m.means.shape[1])]
    return spark.createDataFrame(rows, "c int, dim int, mu double, var double")


@query(_DIAG)
def mixture_table(spark, d):
    path = scratch_path(spark, "mixtures")
    models = _class_models(spark, d)
    md.mixtures_frame(spark, {str(c): m for c, m in models.items()}).write.parquet(path)
    stored = spark.read.parquet(path)
    return _diagonals(spark, {c: md.load_mixture(stored, str(c)) for c in models})


def _model_files(spark, contents: dict, name: str) -> dict:
    """Through files and back: name to bytes."""
    path = _stored(spark, spark.createDataFrame([(str(k), bytearray(v)) for k, v in contents.items()], "utt_id string, content binary"), name)
    return {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).select("path", "content").collect()}


@query(_DIAG)
def mixture_files(spark, d):
    back = _model_files(spark, {c: st.encode_mixture(m, int(c)) for c, m in _class_models(spark, d).items()}, "mixtures")
    return _diagonals(spark, {int(c): st.decode_mixture(b)[1] for c, b in back.items()})


@query(_DIAG)
def mixture_texts(spark, d):
    back = _model_files(spark, {c: st.mixture_text(m).encode() for c, m in _class_models(spark, d).items()}, "mixtures")
    return _diagonals(spark, {int(c): st.parse_mixture_text(b.decode()) for c, b in back.items()})


@query(f"WITH {V_SQL} SELECT c, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(v), 6) + 0.0 AS mu, round(stddev_pop(v), 6) AS sd FROM vl GROUP BY c, dim")
def normalisation_files(spark, d):
    stats = {r["c"]: r for r in cx.dim_stats(vectors(spark, d), "c").collect()}
    back = _model_files(spark, {c: st.encode_normalisation(r["n"], r["mean"], np.square(r["sd"])) for c, r in stats.items()}, "mvn")
    read = {int(c): st.decode_normalisation(b) for c, b in back.items()}
    rows = [(c, i, n, round(float(m[i]), 6) + 0.0, round(float(np.sqrt(v[i])), 6)) for c, (n, m, v) in read.items() for i in range(len(m))]
    return spark.createDataFrame(rows, "c int, dim int, n long, mu double, sd double")


@query(f"""WITH {E_SQL}, s AS (SELECT utt_id, frame_idx, {_KIND} AS i FROM e), c AS (SELECT i, lead(i) OVER (PARTITION BY utt_id ORDER BY frame_idx) AS j FROM s), k AS (SELECT i, j, count(*) AS n FROM c WHERE j IS NOT NULL GROUP BY i, j)
SELECT i, j, round(CAST(CAST(n / sum(n) OVER (PARTITION BY i) AS FLOAT) AS DOUBLE), 6) AS p FROM k""")
def hmm_files(spark, d):
    counts = hmm.normalise(hmm.transition_counts(_kinds(spark, d), "label"))
    a = np.zeros((5, 5))
    for r in counts.collect():
        a[r["i"], r["j"]] = r["p"]
    model = hmm.Hmm(np.full(5, 0.2), a, symbols=np.eye(5))
    back = st.decode_hmm(_model_files(spark, {"model": st.encode_hmm(model, 7)}, "hmm")["model"])[1]
    return spark.createDataFrame([(i, j, round(float(back.a[i, j]), 6)) for i in range(5) for j in range(5) if back.a[i, j] > 0], "i int, j int, p double")


@query(f"""WITH {E_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY utt_id) AS n FROM e), s AS (SELECT utt_id, frame_idx,
  CASE WHEN frame_idx >= floor(3 * n / 4 + 0.5::DOUBLE) THEN 3 WHEN frame_idx >= floor(2 * n / 4 + 0.5::DOUBLE) THEN 2 WHEN frame_idx >= floor(n / 4 + 0.5::DOUBLE) THEN 1 ELSE 0 END AS q FROM n WHERE n >= 4)
SELECT utt_id, 'a ' || count(*) || ' ' || string_agg(CAST(q AS VARCHAR), ' ' ORDER BY frame_idx) AS value FROM s GROUP BY utt_id""")
def alignment_text(spark, d):
    rows = hmm.linear_align(events(spark, d), 4)
    packed = rows.groupBy("utt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "state"))), lambda s: s["state"]).alias("q"))
    segments = packed.select("utt_id", F.lit(0).alias("seg_idx"), F.lit("a").alias("token"), F.size("q").alias("n_frames"), "q")
    return md.alignment_lines(segments)


@query(f"""WITH w AS (SELECT DISTINCT upper(substr(event_type, 1, 1)) AS label FROM events UNION SELECT '?'), i AS (SELECT label, instr('{ALPHABET}', label) - 1 AS id FROM w)
SELECT label, CAST(id AS INTEGER) AS id, CASE WHEN id >= 0 THEN substr('{ALPHABET}', CAST(id AS INTEGER) + 1, 1) ELSE '' END AS back FROM i""")
def label_ids(spark, d):
    rows = table(spark, d, "events").select(F.upper(F.substring("event_type", 1, 1)).alias("label")).union(spark.createDataFrame([("?",)], "label string")).distinct()
    return rows.select("label", label_to_id(F.col("label")).alias("id")).withColumn("back", F.when(F.col("id") >= 0, id_to_label(F.col("id"))).otherwise(F.lit("")))


@query(_LABELLED_SQL.format("CAST(CAST(v AS FLOAT) AS DOUBLE)").replace("CAST(frame_idx % 7 AS SMALLINT) AS y", "CAST(0 AS SMALLINT) AS y"))
def converted_files(spark, d):
    """Binary samples to labelled rows, to text, and to binary samples again; labelled rows have no second label."""
    path, source = _stored(spark, bn.to_sample_files(_labelled(spark, d)), "samples"), "sample_b"
    for target in ("lfv,4", "sample_a", "sample_b"):
        path, source = _stored(spark, bn.convert_files(spark, path, source, target), "converted"), target
    return fr.long_form(_number(bn.read_samples(spark, path)), "c", "y", digits=4)


@query(_LONG.format("CAST(CAST(v AS FLOAT) AS DOUBLE)", 4))
def converted_frames(spark, d):
    """Frames through all formats without labels."""
    path, source = _stored(spark, bn.to_files(lines(spark, d), header=False), "frames"), "ufv,4"
    for target in ("frame_double", "ascii", "frame", "ufv,4", "frame_double"):
        path, source = _stored(spark, bn.convert_files(spark, path, source, target), "converted"), target
    return fr.long_form(_number(bn.read_frames(spark, path, double=True)), digits=4)


@query(f"""WITH {E_SQL}, k AS (SELECT unnest(['byte', 'short', 'int', 'long', 'float', 'double']) AS kind, unnest([100, 30000, 2000000000, 2000000000, 1, 1]) AS top)
SELECT utt_id, kind, big, count(*) AS n, round(sum(CASE WHEN kind = 'float' THEN CAST(CAST(v AS FLOAT) AS DOUBLE) WHEN kind = 'double' THEN v ELSE trunc(v) % 100 END), 3) AS total
FROM e, k, (SELECT unnest([true, false]) AS big) GROUP BY utt_id, kind, big""")
def primitive_files(spark, d):
    """Numbers of each primitive type in both byte orders."""
    rows = events(spark, d)
    out = None
    for kind in bn.PRIMITIVES:
        for big in (True, False):
            value = (lambda x: x[:, 0]) if kind in ("float", "double") else (lambda x: np.trunc(x[:, 0]) % 100)
            path = _stored(spark, bn.pack_files(rows, "x", lambda x, kind=kind, big=big, value=value: bn.encode_values(value(x), kind, big)), kind)

            def run(batches, kind=kind, big=big):
                for batch in batches:
                    read = [bn.decode_values(bytes(c), kind, big).astype(float) for c in batch["content"]]
                    yield pd.DataFrame({"utt_id": [int(p.rsplit("/", 1)[-1]) for p in batch["path"]], "kind": kind, "big": big, "n": [len(v) for v in read], "total": [float(v.sum()) for v in read]})

            own = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "utt_id long, kind string, big boolean, n long, total double")
            out = own if out is None else out.union(own)
    return out.withColumn("total", F.round("total", 3))


@query(f"WITH {E_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY utt_id) AS n FROM e) SELECT utt_id, frame_idx, v FROM n WHERE frame_idx IN (0, 5) OR frame_idx = n - 1")
def buffered_frames(spark, d):
    rows = fr.buffered(events(spark, d))
    return fr.frame_at(rows, [0, 5, -1]).select("utt_id", "frame_idx", F.col("x")[0].alias("v"))

"""The command line: ``python -m strideframe COMMAND ...``. Files in, files out; every command is a thin layer over the operators.

Frame folders hold one frame file per utterance, unless ``--double`` says otherwise in float32.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.operators import acoustic as ac, agreement as ag, decode as dc, features as ft, frames as fr, gaussians as gm, hmm, levels as lv, transforms as tr
from strideframe.session import local_session
from strideframe.sources import binary as bn, models as md, stored as st, text as tx


def _uri(path: str) -> str:
    import os

    return path if "://" in path else f"file://{os.path.abspath(path)}"


def _read(path: str) -> bytes:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(_uri(path))
    with system.open_input_stream(place) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(_uri(path))
    with system.open_output_stream(place) as f:
        f.write(data)


def _frames(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return bn.read_frames(spark, a.frames, getattr(a, "double", False))


def _lexicon(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The recipe's lexicon: a parameter of aligners and decoders."""
    return {r["word"]: list(r["tokens"]) for r in tx.read_lexicon(spark, path).collect()}


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Audio files to feature files."""
    audio = bn.read_audio(spark, a.audio, a.format).select("utt_id", "samples")
    rows = ft.extract(audio, bn.parse_audio_format(a.format)[1], a.window, a.bank, a.selection, a.slopes, a.mvn, energy=a.energy)
    bn.write_files(bn.to_files(rows), _uri(a.out))


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Feature files from one format to another."""
    bn.write_files(bn.convert_files(spark, a.files, a.source, a.target), _uri(a.out))


def vad(spark: SparkSession, a: argparse.Namespace) -> None:
    """Frames with more energy than a threshold, given or estimated."""
    rows = _frames(spark, a)
    loud = rows.select("utt_id", "frame_idx", F.array(fr.energy(F.col("x"))).alias("x"))
    limit = a.threshold if a.threshold is not None else lv.energy_threshold(loud, a.strategy)
    kept = fr.energy_filter(rows, limit)
    number = hmm.Window.partitionBy("utt_id").orderBy("frame_idx")
    bn.write_files(bn.to_files(kept.withColumn("frame_idx", F.row_number().over(number) - 1)), _uri(a.out))
    print(limit)


def durations(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lengths of audio files, and of all of them."""
    audio = bn.read_audio(spark, a.audio, a.format).select("utt_id", F.size("samples").alias("n"))
    for r in ag.durations(audio, "utt_id", "n", bn.parse_audio_format(a.format)[1]).orderBy(F.col("utt_id").isNull(), "utt_id").toLocalIterator():
        print(r["utt_id"] or "all", r["n_samples"], r["length"])


def gauss(spark: SparkSession, a: argparse.Namespace) -> None:
    """A mixture of frames: clustered, refined by EM, stored as a mixture file."""
    rows = _frames(spark, a).persist()
    start = {"kmeans": lambda: gm.kmeans(rows, gm.partitioned_init(rows, a.components, "uniform")), "lbg": lambda: gm.lbg(rows, a.components),
             "hierarchical": lambda: gm.hierarchical(rows, a.components), "gmeans": lambda: gm.gmeans(rows, 0.05, a.components)}[a.start]()
    model, scores = gm.em(rows, start, a.iterations)
    _write(a.out, st.encode_mixture(model))
    print(*scores)


def adapt(spark: SparkSession, a: argparse.Namespace) -> None:
    """MAP adaptation of a mixture file to frames."""
    model = st.decode_mixture(_read(a.mixture))[1]
    _write(a.out, st.encode_mixture(gm.map_update(model, gm.accumulate(_frames(spark, a), model), a.relevance, a.flags)))


def transform(spark: SparkSession, a: argparse.Namespace) -> None:
    """Principal axes of frames, applied to them."""
    rows = _frames(spark, a)
    projection = tr.pca(rows, a.rank)
    bn.write_files(bn.to_files(projection.apply_batches(rows)), _uri(a.out))
    print(*projection.values)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Token models from frames and turns: even alignment first, then so many steps; stored as a codebook file."""
    rows, turns = _frames(spark, a).persist(), tx.read_turns(spark, a.turns)
    alphabet = {r["token"]: int(r["n_states"]) for r in tx.read_alphabet(spark, a.alphabet).collect()}
    if a.mixture:
        pool = st.decode_mixture(_read(a.mixture))[1]
        book = ac.semicontinuous(alphabet, pool) if a.shared else ac.continuous(alphabet, pool)
    else:
        book = ac.continuous(alphabet, gm.gaussian(rows))
    book, scores = ac.train(rows, turns, _lexicon(spark, a.lexicon), book, ["linear", *[a.mode] * a.iterations])
    _write(a.out, st.encode_codebook(book, sorted(alphabet)))
    print(*scores)


def _book(spark: SparkSession, a: argparse.Namespace) -> ac.Codebook:
    tokens = sorted(r["token"] for r in tx.read_alphabet(spark, a.alphabet).select("token").collect())
    return st.decode_codebook(_read(a.codebook), tokens)


def align(spark: SparkSession, a: argparse.Namespace) -> None:
    """Alignments of turns as text, one line per token."""
    rows = hmm.meta_align(_frames(spark, a), tx.read_turns(spark, a.turns), _lexicon(spark, a.lexicon), _book(spark, a).models)
    md.alignment_lines(rows).write.partitionBy("utt_id").text(a.out)


def decode(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best word sequences of utterances under a bigram model."""
    lexicon = _lexicon(spark, a.lexicon)
    ngrams = tx.read_arpa(spark, a.arpa).persist()
    pairs = spark.createDataFrame([(v, w) for v in lexicon for w in lexicon], "w1 string, w2 string")  # the decoder's own table of words by words
    from strideframe.operators import lexicon as lx

    follow: dict = {None: {r["word"]: r["p"] for r in lx.unigram(spark.createDataFrame([(w,) for w in lexicon], "word string"), ngrams, {}).collect()}}
    for r in lx.bigram(pairs, ngrams).collect():
        follow.setdefault(r["w1"], {})[r["w2"]] = r["p"]
    found = dc.decode(_frames(spark, a), lexicon, _book(spark, a).models, follow, beam=a.beam, width=a.width, lm_weight=a.weight, penalty=a.penalty, n_best=a.best)
    for r in found.orderBy("utt_id", "rank").toLocalIterator():
        print(r["utt_id"], r["rank"], f"{r['score']:.4f}", *r["words"])


def words(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best single words of utterances, with silence around them if the lexicon's token for it is named."""
    lexicon, book = _lexicon(spark, a.lexicon), _book(spark, a)
    around = [book[a.silence]] if a.silence else []
    spelled = {w: [*around, *(book[t] for t in tokens), *around] for w, tokens in lexicon.items() if tokens != [a.silence]}
    for r in hmm.isolated_words(_frames(spark, a), spelled, a.best).orderBy("utt_id", "rank").toLocalIterator():
        print(r["utt_id"], r["rank"], r["word"], f"{r['score']:.4f}")


def agreement(spark: SparkSession, a: argparse.Namespace) -> None:
    """Kappa, alpha, Spearman and Pearson of a rater file."""
    ratings = tx.read_ratings(spark, a.ratings).persist()
    print("kappa", ag.kappa(ratings).first()[0])
    for name, metric in ag.METRICS.items():
        print("alpha", name, ag.alpha(ratings, metric).first()[0])
    wide = ratings.groupBy("subject_id").pivot("rater_id", ["0", "1"]).agg(F.first("rating"))
    print("spearman", ag.spearman(wide, "0", "1").first()[0], "pearson", ag.pearson(wide, "0", "1").first()[0])


def stats(spark: SparkSession, a: argparse.Namespace) -> None:
    """Basic statistics of each dimension of frames."""
    long = _frames(spark, a).select(F.posexplode("x").alias("dim", "v"))
    for r in ag.basic_stats(long, "v", "dim").orderBy("dim").collect():
        print(*(r[c] for c in ("dim", "n", "lo", "hi", "median", "mean", "sd")))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("strideframe", description="Frames, models and agreement on Spark.")
    sub = parser.add_subparsers(required=True)

    def command(run, *names: str, **options) -> None:
        p = sub.add_parser(run.__name__, help=run.__doc__)
        for n in names:
            p.add_argument(n)
        for n, default in options.items():
            flag = "--" + n.replace("_", "-")
            if default is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=float if default is None else type(default))
        p.set_defaults(run=run)

    command(extract, "audio", "out", format="t:wav/16", window="hamm,16,10", bank="", selection="0-11", slopes="", mvn="", energy=False)
    command(convert, "files", "out", "source", "target")
    command(vad, "frames", "out", strategy="MEAN", threshold=None, double=False)
    command(durations, "audio", format="t:wav/16")
    command(gauss, "frames", "out", components=4, start="kmeans", iterations=5, double=False)
    command(adapt, "mixture", "frames", "out", relevance=16.0, flags="pmc", double=False)
    command(transform, "frames", "out", rank=2, double=False)
    command(train, "frames", "turns", "alphabet", "lexicon", "out", mixture="", shared=False, mode="viterbi", iterations=3, double=False)
    command(align, "frames", "turns", "alphabet", "lexicon", "codebook", "out", double=False)
    command(decode, "frames", "alphabet", "lexicon", "arpa", "codebook", beam=300, width=1e9, weight=1.0, penalty=1.0, best=1, double=False)
    command(words, "frames", "alphabet", "lexicon", "codebook", silence="", best=1, double=False)
    command(agreement, "ratings")
    command(stats, "frames", double=False)
    return parser


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(arguments)
    a.run(spark or SparkSession.getActiveSession() or local_session("*", app="strideframe"), a)

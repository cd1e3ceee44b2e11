"""Commands from files to files."""

import numpy as np
import pytest

from strideframe.cli import main
from strideframe.errors import InvalidFormatError
from strideframe.sources import binary as bn, stored as st


@pytest.fixture
def corpus(tmp_path):
    """Two tokens at different places, spoken as ab or ba."""
    rng = np.random.default_rng(4)
    (tmp_path / "frames").mkdir()
    where, turns = {"a": [0.0, 0.0], "b": [4.0, 2.0]}, []
    for u in range(6):
        word = "ab" if u % 2 else "ba"
        x = np.concatenate([rng.normal(where[t], 0.3, (8 + u, 2)) for t in word])
        (tmp_path / "frames" / f"u{u}").write_bytes(bn.encode_frames(x))
        turns.append(f"u{u} {word}")
    (tmp_path / "turns").write_text("\n".join(turns))
    (tmp_path / "alphabet").write_text("a 2\nb 2\n")
    (tmp_path / "lexicon").write_text("ab a b\nba b a\n")
    (tmp_path / "arpa").write_text("\\data\\\nngram 1=2\nngram 2=1\n\n\\1-grams:\n-0.3 ab -0.1\n-0.3 ba\n\n\\2-grams:\n-0.2 ab ba\n\n\\end\\\n")
    return tmp_path


def test_recipe(spark, corpus, capsys):
    run = lambda *a: (main([str(corpus / x) if x in files else x for x in a], spark), capsys.readouterr().out)[1]
    files = {"frames", "turns", "alphabet", "lexicon", "arpa", "book", "pool", "adapted", "aligned", "kept", "axes", "text"}
    assert len(run("gauss", "frames", "pool", "--components", "2", "--iterations", "2").split()) == 2
    assert np.allclose(sorted(st.decode_mixture((corpus / "pool").read_bytes())[1].means[:, 0]), [0, 4], atol=0.3)
    run("adapt", "pool", "frames", "adapted", "--relevance", "4")
    assert len(run("train", "frames", "turns", "alphabet", "lexicon", "book", "--iterations", "2").split()) == 3
    run("align", "frames", "turns", "alphabet", "lexicon", "book", "aligned")
    lines = {p.parent.name: p.read_text().split("\n")[:2] for p in (corpus / "aligned").glob("utt_id=*/*.txt")}
    assert lines["utt_id=u1"][0].startswith("a 9 ") and lines["utt_id=u1"][1].startswith("b 9 ")
    said = {line.split()[0]: line.split()[2] for line in run("words", "frames", "alphabet", "lexicon", "book").splitlines()}
    assert said == {f"u{u}": "ab" if u % 2 else "ba" for u in range(6)}
    decoded = {line.split()[0]: line.split()[3:] for line in run("decode", "frames", "alphabet", "lexicon", "arpa", "book").splitlines()}
    assert all(decoded[u][0] == w for u, w in said.items())
    run("train", "frames", "turns", "alphabet", "lexicon", "book", "--mixture", str(corpus / "pool"), "--shared", "--mode", "expected", "--iterations", "1")
    assert st.decode_codebook((corpus / "book").read_bytes(), ["a", "b"]).shared is not None
    assert len(run("stats", "frames").splitlines()) == 2
    assert float(run("vad", "frames", "kept", "--threshold", "3.0")) == 3.0 and (corpus / "kept" / "u0").stat().st_size < (corpus / "frames" / "u0").stat().st_size
    assert len(run("transform", "frames", "axes", "--rank", "1").split()) == 1
    run("convert", "frames", "text", "frame", "ascii")
    assert len((corpus / "text" / "u0").read_text().splitlines()) == 16


def test_audio_and_ratings(spark, tmp_path, capsys):
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "a.wav").write_bytes(bn.to_wav(np.sin(np.arange(16000) / 5), 16000))
    main(["extract", str(tmp_path / "audio"), str(tmp_path / "out"), "--slopes", "3:1"], spark)
    assert bn.read_frames(spark, str(tmp_path / "out")).first()["x"].__len__() == 24
    main(["durations", str(tmp_path / "audio")], spark)
    assert "00:00:01" in capsys.readouterr().out
    (tmp_path / "r.txt").write_text("1 1\n2 2\n3 2\n4 nan\n")
    main(["agreement", str(tmp_path / "r.txt")], spark)
    assert "alpha nominal" in capsys.readouterr().out


def test_formats():
    x = np.array([[1.5, -2.0], [0.25, 8.0]])
    data = bn.encode_samples([3, -4], [1, 0], x)
    for path in (["lfv,2"], ["sample_a"], ["lfv,2", "sample_a"], ["sample_a", "lfv,2"]):
        at, kind = data, "sample_b"
        for to in [*path, "sample_b"]:
            at, kind = bn.convert(at, kind, to), to
        c, y, back = bn.decode_samples(at)
        assert c.tolist() == [3, -4] and y.tolist() == ([1, 0] if path == ["sample_a"] else [0, 0]) and np.array_equal(back, x)
    assert bn.convert(bn.encode_frames(x), "frame", "ascii") == b"1.5\t-2.0\n0.25\t8.0\n"
    for bad in ("lfv", "ufv,0", "frame,3", "none"):
        with pytest.raises(InvalidFormatError):
            bn.convert(b"", bad, "frame")
    with pytest.raises(InvalidFormatError):
        bn.decode_labelled(b"abc" + b"\0" * 17, 2)
    for kind in bn.PRIMITIVES:
        for big in (False, True):
            assert bn.decode_values(bn.encode_values([1, -2, 100], kind, big), kind, big).tolist() == [1, -2, 100]
    assert bn.encode_values([1], "int", True) == b"\0\0\0\1"
    with pytest.raises(InvalidFormatError):
        bn.decode_values(b"abc", "int")

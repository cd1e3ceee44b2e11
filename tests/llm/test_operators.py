"""Each operator against brute force and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strideframe.llm import bpe, chat, decontaminate, language, line_dedup, minhash, quality, sharding, url_filter, warc

WORDS = "the of and stone river light house quiet morning garden letter window bridge winter summer paper music forest mountain silver".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- URL filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("x.org", "", "block")]


def judged(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(h + p, len(h), v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda r: (len(r[0]), r[1], r[2])) if fits else (None, 0, "allow")
    return host, path, rule[0], rule[2]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_filter(spark, limit):
    urls = ["http://a.example.org/en/12?x", "http://EXAMPLE.org/es/", "https://example.org", "ftp://x.org#a", "nothing", None, "", "http://deep.sub.x.org/", "http://notexample.org/es/", "http://.org/", "a://b://c.org/", "http://example.org/es/"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, "ftp://x.org#a", "h", "r"), (None, "http://x.org/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_filter.filter_urls(pages, rules, broadcast_bytes=limit)
    expected = Counter((i, *judged(u)) for i, u, _, _ in rows)
    assert Counter(map(tuple, found.select("page_id", "host", "path", "rule", "verdict").collect())) == expected
    assert url_filter.filter_urls(pages, rules.limit(0)).filter("rule IS NULL AND verdict = 'allow'").count() == len(rows)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


# ---- line dedup

def brute_lines(rows):
    edits = lambda a, b: a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1) or (abs(len(a) - len(b)) == 1 and any(
        max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
    place = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.split():
                first[line] = min(first.get(line, ((True, 1 << 70), 0)), (place(i), n))
    gone = {a for a in first for b in first if a != b and first[b] < first[a] and min(len(a.split()), len(b.split())) >= 8 and edits(a.split(), b.split())}
    left = []
    for i, t in rows:
        keep = [line for n, line in enumerate((t or "").split("\n")) if not line.split() or ((place(i), n) == first[line] and line not in gone)]
        left.append((i, None if t is None else "\n".join(keep)))
    return left


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup(make, limit):
    base = prose(1, 12)
    w = base.split()
    rows = [(5, base + "\n\nshort one\n" + prose(2, 9)), (1, " ".join([*w[:4], "changed", *w[5:]]) + "\nshort two"), (2, " ".join(w[:6] + w[7:])), (3, " ".join([*w, "more"])),
            (4, " ".join(["other", *w[1:-1], "end"])), (6, base), (7, None), (8, ""), (9, "short one\n \n" + prose(3, 400)), (10, "x\n" + prose(3, 400) + " tail"), (11, base.replace(" ", "  ", 1)), (None, base), (12, "\n")]
    rng = random.Random(4)
    for k in range(20):
        v = w.copy()
        v[rng.randrange(12)] = rng.choice(WORDS)
        rows.append((100 + k, " ".join(v)))
    docs = make(*rows)
    found = line_dedup.dedup_lines(docs, broadcast_bytes=limit)
    assert found.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=key) == sorted(brute_lines(rows), key=key)
    assert line_dedup.dedup_lines(make().limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_line_dedup_ids(spark, kind):
    """Negative, repeated, null and text ids; columns named like those used inside."""
    name = (lambda i: i) if kind == "long" else (lambda i: None if i is None else f"{i + (1 << 63):020d}")
    rows = [(-1, "alpha one\nbeta two\ngamma three"), (-(1 << 63), "x first\nalpha one"), (1, "a b"), (5, "a b\nfoo bar"), (5, "foo bar\nzzz"), (5, "foo bar\nzzz"),
            ((1 << 63) - 1, "zzz\nlast"), (None, "a b\nnull line"), (None, "other null\nnull line"), (None, None)]
    clash = "_id long, _stay string, stay string, of string, which int, `a.b` string, pos int, h1 string"
    docs = spark.createDataFrame([(name(i), t, 1, "s", "s", "o", 2, "d", 3, "h") for i, t in rows], f"doc_id {kind}, text string, {clash}")
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    found = left.collect()
    assert {tuple(r)[2:] for r in found} == {(1, "s", "s", "o", 2, "d", 3, "h")}
    texts = Counter((r["doc_id"], r["text"]) for r in found)
    nulls = sorted((t for (i, t), _ in texts.items() if i is None and t is not None), key=len)
    assert nulls in (["", "other null\nnull line"], ["null line", "other null"])
    expected = [(-1, "beta two\ngamma three"), (-(1 << 63), "x first\nalpha one"), (1, "a b"), (5, ""), (5, "foo bar\nzzz"), (5, "foo bar\nzzz"), ((1 << 63) - 1, "last")]
    assert Counter({k: v for k, v in texts.items() if k[0] is not None}) == Counter((name(i), t) for i, t in expected)
    assert texts[(None, None)] == 1


def test_line_variants_stay_short(spark):
    """The plan holds no constant arrays, and running XORs are right at every length."""
    df = spark.createDataFrame([([(i * 2654435761) % 1000003 for i in range(n)],) for n in (0, 1, 2, 7, 1000, 5000)], "a array<long>")
    for r in df.select("a", line_dedup.running_xor(F.col("a")).alias("x")).collect():
        acc = 0
        for a, x in zip(r["a"], r["x"], strict=True):
            acc ^= a
            assert acc == x
    plan = spark.createDataFrame([("a b",)], "t string").select(line_dedup.variants(line_dedup.line_words(F.col("t"))))
    assert len(plan._jdf.queryExecution().toString()) < 200_000


# ---- sharding

def test_sharding(spark, make):
    rows = [(i, prose(i, 5 + i % 60)) for i in range(600)] + [(1000 + i, "a very common text " * 5) for i in range(300)] + [(2000, None), (2001, ""), (None, "none"), (7, prose(7, 12)), (7, prose(7, 12))]
    found = sharding.assign(make(*rows)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, size(t), None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(16))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    total = sum(size(t) for _, t in rows)
    assert max(abs(sum(r["size"] for r in rs) - total / 16) for rs in by.values()) <= 2 * max(size(t) for _, t in rows)
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}
    assert sharding.assign(make().limit(0)).count() == 0


@pytest.mark.parametrize("copies,ranges,fair", [((300, 90, 40, 7), 192, 1 << 32), ((2000,), 8, 700), ((), 4, 1 << 32), ((120, 119, 118, 117), 192, 2000)])
def test_sharding_keeps_groups(spark, copies, ranges, fair):
    """Equal texts share a shard unless none has room; sizes are nearly equal; slots have no gaps; rows may share ids."""
    rows = [(i, prose(i, 5 + i % 60)) for i in range(800)] + [(10_000 * (g + 1) + k // 2, prose(5000 + g, 30)) for g, n in enumerate(copies) for k in range(n)]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, size int, bucket string")
    found = sharding.assign(docs, ranges=ranges, range_bytes=fair).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    size = lambda t: len(t.encode()) + 1
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, size(t)) for i, t in rows)
    mean, loads, of, slots = sum(size(t) for _, t in rows) / 16, Counter(), {}, {}
    for r in found:
        loads[r["shard"]] += r["size"]
        of.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(loads) == set(range(16))
    assert max(abs(b - mean) for b in loads.values()) <= sharding.LARGE * mean + 2 * max(size(t) for _, t in rows)
    weight = Counter()
    for _, t in rows:
        weight[t] += size(t)
    assert all(len(s) == 1 for t, s in of.items() if weight[t] <= sharding.LARGE * mean)
    assert all(len(s) <= weight[t] // mean + 2 for t, s in of.items())
    if copies and weight[prose(5000, 30)] < mean:
        assert len(of[prose(5000, 30)]) == 1


# ---- decontamination

def brute_leaks(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = norm(text), set(), set()
    for item, t in items:
        iw = norm(t)
        n = min(10, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, make, block):
    items = [(1, prose(50, 30)), (2, "Short, Question?"), (3, ""), (4, None), (10, prose(51, 10)), (1, prose(52, 12)), (None, "river")]
    inside = prose(50, 30).split()
    rows = [(1, "Intro. " + " - ".join(inside[3:15]).upper() + " end"), (2, "a SHORT\nquestion here, short questions"), (3, None), (4, ""), (5, " ".join(inside[:9])), (6, prose(60, 3000) + " " + prose(51, 10)),
            (7, prose(52, 12) + " " + prose(52, 12)), (7, prose(52, 12)), (8, "Éa short question é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(make(*rows), bench, block_bytes=block).collect()
    expected = Counter((i, *map(repr, brute_leaks(t, [x for x in items if x[0] is not None]))) for i, t in rows)
    assert Counter((r["doc_id"], repr(r["leak"]["n_words"]), repr(r["leak"]["n_hit"]), repr(list(r["leak"]["items"]))) for r in found) == expected
    first = next(r for r in found if r["doc_id"] == 1)["leak"]["spans"][0]
    assert rows[0][1][first["start"] : first["end"]] == " - ".join(inside[3:15]).upper()
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(make(*rows), bench).collect()} == {i for i, t in rows if not brute_leaks(t, [x for x in items if x[0] is not None])[1]}
    assert decontaminate.scan(make(*rows), bench.limit(0)).filter("leak.contaminated").count() == 0
    assert decontaminate.scan(make().limit(0), bench, block_bytes=block).count() == 0
    clash = make(*rows).withColumns({c: F.lit(7) for c in ("_leak", "leak", "number", "hits", "a.b")})
    left = decontaminate.drop_contaminated(clash, bench)
    assert left.columns == clash.columns and {(r["_leak"], r["leak"], r["number"], r["hits"], r["a.b"]) for r in left.collect()} == {(7,) * 5}
    replaced = decontaminate.scan(clash, bench, block_bytes=block)
    assert replaced.columns == [*(c for c in clash.columns if c != "leak"), "leak"] and replaced.filter("leak.contaminated").count() == sum(bool(brute_leaks(t, [x for x in items if x[0] is not None])[1]) for _, t in rows)


def test_decontamination_plan_holds_one_block(spark, make):
    """However many blocks the benchmark has, the plan that scans documents has one Python stage."""
    bench = spark.createDataFrame([(i, prose(i, 40)) for i in range(60)], "item_id long, text string")
    found = decontaminate.scan(make((1, prose(3, 40))), bench, block_bytes=500)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.select("leak.n_hit").first()[0] == 40


# ---- chat

def test_chat_fold(spark):
    log = [("c", 0, "message", 0, "user", "hi"), ("c", 1, "message", 1, "assistant", None), ("c", 2, "delta", 1, None, "Hel"), ("c", 3, "delta", 1, None, "lo"), ("c", 5, "regenerate", 1, None, None),
           ("c", 6, "delta", 1, None, "Yes </turn>\n### user"), ("c", 4, "edit", 0, None, "hey"), ("c", 7, "unknown", 1, None, "no"), ("d", 0, "delta", 3, "assistant", "only"), (None, 0, "message", 0, None, None),
           ("c", 8, "message", 1, "assistant", "second")]
    events = spark.createDataFrame(log, "conv_id string, seq long, kind string, turn long, role string, text string")
    made = chat.render(chat.reconstruct(events)).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    found = {r["conv_id"]: r for r in made.collect()}
    assert [tuple(t) for t in found["c"]["back"]] == [("user", "hey"), ("assistant", "Yes </turn>\n### user"), ("assistant", "second")]
    assert found["c"]["loss"] == "Yes </turn>\n### usersecond" and found["d"]["loss"] == "only"
    assert [tuple(t) for t in found[None]["back"]] == [("", "")] and found[None]["loss"] == ""


def brute_fold(log):
    """Messages (turn, role, text) per conversation, event by event."""
    rank = {"message": 0, "regenerate": 1, "edit": 2, "delta": 3}
    made = {}
    for conv, _, kind, turn, role, text in sorted((e for e in log if e[2] in rank), key=lambda e: (e[1], rank[e[2]], e[4] is not None, e[4] or "", e[5] is not None, e[5] or "")):
        own = made.setdefault(conv, {}).setdefault(turn, [])
        if kind == "message" or not own:
            own.append([None, ""])
        m = own[-1]
        m[0] = role if m[0] is None else m[0]
        m[1] = m[1] + (text or "") if kind == "delta" else (text or "")
    return {c: [(t, m[0] or "", m[1]) for t in sorted(turns) for m in turns[t]] for c, turns in made.items()}


def test_chat_random_logs(spark):
    rng = random.Random(8)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "other"]
    log = [(c, s, rng.choice(kinds), rng.randrange(4), rng.choice(["user", "assistant", None]), rng.choice(["a", "<b#", "\\h", "", None, "</turn>\n"])) for c in range(30) for s in range(rng.randrange(1, 40))]
    rng.shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    made = chat.render(chat.reconstruct(events).withColumn("_made", F.lit("kept")).withColumn("made", F.lit(1)))
    found = made.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    expected = brute_fold(log)
    assert {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in found} == expected
    for r in found:
        own = expected[r["conv_id"]]
        assert [tuple(t) for t in r["back"]] == [m[1:] for m in own] and r["loss"] == "".join(m[2] for m in own if m[1] == "assistant")
        assert (r["_made"], r["made"]) == ("kept", 1)


def test_chat_log_gives_the_rows_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\U0001F600 x"), (1, 1, "assistant", "\U0001F600 x"), (1, 2, None, None), (2, None, "assistant", None), (None, 0, "assistant", "odd length")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.to_events(table)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    found = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.reconstruct(log).collect()}
    expected = {}
    for c, t, role, text in rows:
        expected.setdefault(c, []).append((t, role or "", text or ""))
    assert found == expected
    assert chat.reconstruct(chat.to_events(table.limit(0))).count() == 0


def test_chat_escapes(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\", "\\\\h#<", "\n\n", "### x\n</turn>\n", "\\b\\l", "é😀<#", "", "a" * 50000]
    events = spark.createDataFrame([("k", i, "message", i, r, t) for i, (r, t) in enumerate(zip(["assistant", "us\ner#"] * 5, nasty))], "conv_id string, seq long, kind string, turn long, role string, text string")
    made = chat.render(chat.reconstruct(events))
    row = made.select("formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("back")).first()
    assert [t["text"] for t in row["back"]] == nasty and row["back"][1]["role"] == "us\ner#"
    assert len(row["loss_spans"]) == 5
    assert made.select(chat.read_loss(F.col("formatted"), F.col("loss_spans"))).first()[0] == "".join(nasty[::2])


# ---- MinHash

def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_minhash(make, limit):
    rng, rows = random.Random(9), [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "\u3000"), (3, prose(70, 60)), (3, prose(70, 60))]
    for g in range(3):
        base = prose(80 + g, 150).split()
        for k in range(25):
            v = base.copy()
            for _ in range(rng.choice((0, 1, 2, 4, 8))):
                v[rng.randrange(150)] = f"w{rng.randrange(99)}"
            rows.append((1000 * (g + 1) + k, " ".join(v)))
    found = minhash.near_duplicates(make(*rows), broadcast_bytes=limit)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == brute_components(rows)
    kept = minhash.keep_one(make(*rows))
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_components(rows)}
    assert minhash.near_duplicates(make().limit(0)).count() == 0


def test_minhash_loose_group(spark):
    """Many texts that are alike but mostly below the bound: equal to brute force, with far fewer pairs than all."""
    rng, rows = random.Random(19), []
    base = prose(90, 120).split()
    for k in range(300):
        v = base.copy()
        for _ in range(rng.choice((0, 1, 2, 3, 5, 6, 7, 8, 9))):
            i = rng.randrange(len(v))
            v[i : i + 1] = rng.choice(([], [rng.choice(WORDS)], [rng.choice(WORDS), v[i]], [f"x{k}"]))
        rows.append((k, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tested = []
    compare = minhash._Finder.compare
    try:
        minhash._Finder.compare = lambda *a: tested.append(compare(*a)) or tested[-1]
        found = minhash.near_duplicates(docs).collect()
    finally:
        minhash._Finder.compare = compare
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)
    assert len({c for _, _, c in brute_components(rows)}) > 50 and sum(t for t, _ in tested) < 300 * 300 / 2 / 4


def test_keep_one_clashing_columns(spark):
    rows = [(1, prose(1, 30)), (2, prose(1, 30)), (3, prose(2, 30)), (3, prose(3, 30)), (3, prose(3, 30))]
    docs = spark.createDataFrame([(i, t, 1, "a", "b", "c", "d", 2) for i, t in rows], "doc_id long, text string, _gone long, gone string, `set` string, again string, _cls string, `row.x` int")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([rows[0], rows[2], rows[3]])


def test_keep_one_decides_by_row(make):
    copied, other = prose(200, 40), prose(201, 40)
    rows = [(1, copied), (None, copied), (None, other), (None, ""), (None, None),  # a null id copies a document; other null ids stay
            (5, prose(202, 40)), (6, prose(202, 40)), (6, prose(203, 40)),  # a unique text with the id of a rejected row
            (7, prose(204, 40)), (7, prose(204, 40)), (7, prose(204, 40).upper()),  # one id, one set
            (8, prose(205, 40)), (8, prose(206, 40)), (9, prose(206, 40)), (9, prose(205, 40)),  # two components with one smallest id
            (10, ""), (10, ""), (None, prose(207, 40)), (None, prose(207, 40))]
    expected = [(1, copied), (None, other), (None, ""), (None, None), (5, prose(202, 40)), (6, prose(203, 40)), (7, prose(204, 40).upper()),
                (8, prose(205, 40)), (8, prose(206, 40)), (10, ""), (10, ""), (None, prose(207, 40))]
    kept = minhash.keep_one(make(*rows))
    assert kept.columns == make(*rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(expected)
    plain = [(1, copied), (2, copied), (3, other)]
    assert Counter(r["doc_id"] for r in minhash.keep_one(make(*plain)).collect()) == Counter([1, 3])


# ---- quality

def brute_measures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts, covered = Counter(wins), set()
    for i, x in enumerate(wins):
        if counts[x] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(make):
    texts = [None, "", " \n\t", prose(1, 30), prose(2, 7), "a b c d e f g h " * 5, prose(3, 20) + "\n" + prose(3, 20), "x\u00a0y é\x85z " * 10, "### | <b> " * 30, prose(4, 3000) + " " + prose(4, 3000), "l\nl\nl\n\n", "THE!! OF!! " * 30]
    judged_docs = quality.judge(make(*enumerate(texts)), out="key")
    assert len(judged_docs.columns) == 8
    for r in judged_docs.collect():
        m, expected = r["key"], brute_measures(texts[r["doc_id"]])
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == expected
        assert m["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
    kept = {r["doc_id"] for r in quality.keep_good(make(*enumerate(texts))).collect()}
    assert kept == {r["doc_id"] for r in judged_docs.filter("key.kept").collect()} and 3 in kept and 8 not in kept and 11 not in kept


# ---- WARC

def pages(spark, n=600):
    rows = [(i, f"http://x.org/{i}", f"<p>é {prose(i, 5)}</p>") for i in range(n)] + [(None, "http://n.org", None), (5, None, "<p>again</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute_audit(kept, copy):
    """Multisets of (id, url): equal digests cancel out, the rest pairs off."""
    status = Counter()
    for key in {(f, i, u) for f, i, u, _ in kept + copy}:
        was, now = (Counter(d for f, i, u, d in side if (f, i, u) == key) for side in (kept, copy))
        lost, new = sum((was - now).values()), sum((now - was).values())
        status[key, "corrupt"] += min(lost, new)
        status[key, "missing"] += max(0, lost - new)
        status[key, "extra"] += max(0, new - lost)
    return +status


def test_fixity_audit(spark):
    records = warc.to_records(pages(spark), per_file=64)
    kept = warc.manifest(records).persist()
    assert warc.audit(kept, kept, 64, 4).count() == 0
    rng = random.Random(12)
    rows = [tuple(r) for r in records.select("file", "page_id", "url", "record").collect()]
    rows += [(rows[5][0], rows[5][1], rows[5][2], f"again {k}") for k in range(4)]  # one id and URL, several texts
    for part in range(3):
        copy = [(f, i, u, t if rng.random() > 0.03 else t + "x" * rng.randrange(3)) for f, i, u, t in rows if rng.random() > 0.02]
        copy += [(f, None if i is None else -i, u, t) for f, i, u, t in rows if rng.random() < 0.01] * (part + 1)
        sides = [spark.createDataFrame(x, "file long, page_id long, url string, record string") for x in (rows, copy)]
        found = warc.audit(*map(warc.manifest, sides), 64, 4).collect()
        digest = lambda side: [(f, i, u, hashlib.sha256(t.encode()).hexdigest()) for f, i, u, t in side]
        assert Counter((((r["file"], r["page_id"], r["url"]), r["status"])) for r in found) == brute_audit(digest(rows), digest(copy))
        texts = {}
        for f, _, _, t in sorted(copy, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", hashlib.sha256(r[3].encode()).hexdigest())):
            texts[f] = texts.get(f, b"") + t.encode()
        for r in found:
            if r["copy_start"] is not None:  # the place holds the bytes that were hashed
                assert hashlib.sha256(texts[r["file"]][r["copy_start"] : r["copy_stop"]]).hexdigest() == r["copy_digest"]
    assert {r["status"] for r in warc.audit(kept, kept.limit(0), 64, 4).collect()} == {"missing"}
    assert warc.audit(kept.limit(0), kept, 64, 4).filter("status = 'extra'").count() == kept.count()
    assert warc.audit(kept.limit(0), kept.limit(0), 64, 4).count() == 0


def test_repeated_ids_fill_several_files(spark):
    rows = [(1, f"http://x.org/{k}", "<p>") for k in range(500)] + [(2, "u", None)]
    records = warc.to_records(spark.createDataFrame(rows, "page_id long, url string, html string"), per_file=8, overfull=4)
    sizes = [r["count"] for r in records.groupBy("file").count().collect()]
    assert sum(sizes) == 501 and max(sizes) < 60
    assert warc.audit(warc.manifest(records), warc.manifest(records), 8, 4).count() == 0


def test_warc_round_trip(spark, tmp_path):
    records = warc.to_records(pages(spark, 20).filter("page_id IS NOT NULL AND url IS NOT NULL"))
    warc.write_warc(records, str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    twice = warc.to_records(spark.createDataFrame([(1, "u", "b"), (1, "u", "a"), (1, "u", "a"), (None, None, None)], "page_id long, url string, html string"))
    warc.write_warc(twice, str(tmp_path / "t"))
    own = [hashlib.sha256(r["record"]).hexdigest() for r in sorted(warc.read_warc(spark, str(tmp_path / "t")).collect(), key=lambda r: (r["path"], r["start"]))]
    assert sorted(own) == sorted(r["digest"] for r in warc.manifest(twice).collect())
    assert [d for d in own if d in {r["digest"] for r in warc.manifest(twice).filter("page_id = 1").collect()}] == [r["digest"] for r in warc.manifest(twice).filter("page_id = 1").orderBy("ord").collect()]
    assert {(r["url"], bytes(r["record"])) for r in read.collect()} == {(r["url"], r["record"].encode()) for r in records.collect()}
    starts = warc.manifest(records).select("start", "stop").collect()
    assert {tuple(r) for r in read.select("start", "stop").collect()} == {tuple(r) for r in starts}


# ---- BPE

def test_bpe_against_tiktoken(spark, make, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    true = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0xA0, 0x85, 0x1C, 0x2028, 0xB2, 0xE9, 0x301, 0x4E2D, 0x1F600, 0x660, 0xAA)]
    texts = [None, "", " ", "  a", "don't  stop\n\nnow ", "<|endoftext|>", "a" * 3000, prose(5, 2000), *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400))]
    docs = make(*enumerate(texts))
    ids = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs, path, pattern).collect()}
    assert ids == {i: true.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.round_trip(docs, path, pattern).collect():
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[r["doc_id"]])).encode()).hexdigest() and r["n_tokens"] == len(ids[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


@pytest.mark.parametrize("own", [r"\S|\s", r"\w+|[^\w]", r"(?:[a-c]+)|.", r"(a|b)+ ?|[^ab]+"])
def test_bpe_other_patterns(make, vocabulary, own):
    import tiktoken

    with open(vocabulary[0], "rb") as f:
        ranks = bpe.read_ranks(f.read())
    true = tiktoken.Encoding("own", pat_str=own, mergeable_ranks=ranks, special_tokens={})
    texts = ["abc de", "don't  stop\n\nnow ", prose(5, 200), "\u00e9t\u00e9 \u4e2d", None, ""]
    ids = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(make(*enumerate(texts)), vocabulary[0], own).collect()}
    assert ids == {i: true.encode_ordinary(t or "") for i, t in enumerate(texts)}
    for r in bpe.round_trip(make(*enumerate(texts)), vocabulary[0], own).collect():
        assert r["decoded_sha256"] == hashlib.sha256(true.decode_bytes(ids[r["doc_id"]])).hexdigest()


def test_prefix_tables(vocabulary):
    with open(vocabulary[0], "rb") as f:
        v = bpe.Vocabulary(bpe.read_ranks(f.read()))
    rng = random.Random(3)
    for _ in range(60):
        data = "".join(rng.choice("abc theion ") for _ in range(200)).encode()
        whole = bpe.PrefixTable(v, data)
        assert bpe.PrefixTable(v, data[:90]).append(data[90:]).last == whole.last and whole.ids() == v.merge(data)
        a = rng.randrange(200)
        b, new = rng.randrange(a, 200), b"new" * rng.randrange(3)
        steps = whole.edit(a, b, new)
        assert whole.last == bpe.PrefixTable(v, data[:a] + new + data[b:]).last and steps <= len(whole.data) - a


# ---- languages

def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "123 !?", "de"), (-3, "", None), (None, "the river and the house", "en")], docs.schema)
    model = language.fit(docs.union(extra), ~language.held_out(F.col("doc_id")), per_language=60)
    found = language.predict(docs.union(extra).withColumn("score", F.lit("clash")), model).withColumn("held", language.held_out(F.col("doc_id"))).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] is not None and r["doc_id"] < 0)
    scored = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 0]
    assert all(0 <= r["score"] <= 1 for r in scored)
    unseen = [r for r in scored if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) >= 0.95 * len(unseen)
    assert language.predict(extra, language.fit(docs.limit(0), F.lit(True))).filter("lang_pred <> 'und'").count() == 0
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in unseen} == {True}


def slow_features(text):
    """The same counts, one n-gram at a time."""
    raw = []
    for c in text.encode():
        if 65 <= c <= 90:
            c += 32
        elif not (97 <= c <= 122 or c >= 128):
            c = 32
        raw.append(c)
    upper = [i > 0 and raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E for i in range(len(raw))]
    raw = [c + 32 if u else c for c, u in zip(raw, upper)]
    line = [32, *(c for i, c in enumerate(raw) if i == 0 or c != 32 or raw[i - 1] != 32), 32]
    counts = [0] * language.DIMENSIONS
    for n in range(1, 5):
        for i in range(len(line) - n + 1):
            h = line[i]
            for c in line[i + 1 : i + n]:
                h = h * 16777619 % 2**32 ^ c
            counts[(h * 2654435761 % 2**32) >> 20] += 1
    length = sum(counts) ** 0.5
    return [c**0.5 / length for c in counts]


def test_language_by_hand():
    """Features and votes written out, without arrays."""
    texts = ["the river and the house by the light", "der Fluss und das Haus am Licht", "le fleuve et la maison", "el río y la casa Ñandú", "ÀÉ une forêt  d'été!", "x"]
    for t in texts:
        assert all(abs(a - b) < 1e-5 for a, b in zip(language.features(t).tolist(), slow_features(t), strict=True))
    x = language.np.array([language.features(t + " " + w) for t in texts[:4] for w in ("one", "two", "six")])
    model = language.Model(x, [k for k in ("en", "de", "fr", "es") for _ in range(3)])
    chance = lambda m: 1 / (1 + 2.718281828459045 ** (-2 * m))
    for t in texts:
        f = [*slow_features(t), 1.0]
        margin = lambda w: sum(a * b for a, b in zip(w.tolist(), f))
        families = {k: margin(w) for k, w in model.by_family.items()}
        family = max(sorted(families), key=families.get)
        (a, b), w = next((k, w) for k, w in model.by_pair.items() if k[0] in model.members[family])
        best, own = (a, margin(w)) if margin(w) > 0 else (b, -margin(w))
        found, score = model.predict(t)
        assert found == best and abs(score - chance(families[family]) * chance(own)) < 1e-4


def test_every_label_is_learned(spark):
    """More labels than fit at full share: the row budget is divided, no label is left out."""
    rng = random.Random(6)
    word = lambda k: "".join(chr(97 + (k * 7 + rng.randrange(5)) % 26) for _ in range(6)) + chr(0x430 + k % 32)
    rows = [(100 * k + i, " ".join(word(k) for _ in range(30)), f"x{k:02d}") for k in range(90) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), most_rows=180)
    assert model.langs == sorted({r[2] for r in rows})
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} <= set(model.langs)


# ---- pipeline

def brute_verdict(text):
    n, chars, symbols, dup, repeated = brute_measures(text)
    if n < 20 or 100 * repeated > 30 * n:
        return False
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    stops = {*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return 3 <= chars / n <= 12 and symbols / n <= 0.1 and text.count("!") / n <= 0.3 and sum(w in stops for w in words) / n >= 0.01 and dup / len(lines) <= 0.5 and len(lines) / n <= 0.5


def brute_pipeline(rows, items, vocabulary):
    """All stages over (doc_id, text) with distinct ids: (doc_id, tokens, text) of what is left, and what each stage keeps."""
    import tiktoken

    kept = [r for r in rows if brute_verdict(r[1])]
    after = [{i for i, _ in kept}]
    kept = [(i, t) for (i, t), (_, old) in zip(brute_lines(kept), kept) if t is not None and t.split() or not (old or "").split()]
    after.append({i for i, _ in kept})
    stay = {c for _, n, c in brute_components(kept)}
    kept = [(i, t) for i, t in kept if i in stay]
    after.append(stay)
    kept = [(i, t) for i, t in kept if not brute_leaks(t, items)[1]]
    after.append({i for i, _ in kept})
    path, pattern = vocabulary
    with open(path, "rb") as f:
        true = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    return {i: (true.encode_ordinary(t or ""), t or "") for i, t in kept}, after


def result_rows(found):
    return {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()}


def digests(left):
    return {i: (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, (ids, t) in left.items()}


def test_pipeline_stages(spark, sf_dir, vocabulary):
    """The whole run, and each stage on what the one before it kept, against brute force."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left, after = brute_pipeline(rows, items, vocabulary)
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"] and after[-1] != after[0]
    at = docs
    for (_, stage), ids in zip(cp.STAGES[:-1], after):
        at = stage(spark, at, sf_dir).persist()
        assert at.columns == docs.columns and {r["doc_id"] for r in at.select("doc_id").collect()} == ids and at.count() == len(ids)
    assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
    assert result_rows(cp.run(spark, sf_dir)) == digests(left)


def test_pipeline_edges(spark, tmp_path, vocabulary):
    """Nulls in every column, empty and long texts, copies, repeated rows, clashing names and empty tables."""
    import corpus_pipeline as cp

    long = prose(300, 30) + "\n" + "\n".join(f"the line {k} of " + prose(400 + k, 12) for k in range(300))
    leak = prose(900, 14)
    rows = [(1, prose(301, 60)), (2, prose(301, 60)), (3, prose(301, 60).upper()), (4, None), (5, ""), (6, " \n\t"), (7, "short"), (8, long), (9, prose(302, 40) + " " + leak), (10, prose(303, 40)), (11, "the " * 50), (12, prose(304, 25) + "\n\n" + prose(303, 40))]
    extra = "_had boolean, had string, _gone int, gone int, leak string, `a.b` string, cls string, number long"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    wide = lambda rs: spark.createDataFrame([(i, t, None, None, None, None, None, 1, None, "x", "y", None, 2) for i, t in rs], schema)
    items = [(1, leak), (2, None), (None, "the")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wide(rows).write.parquet(str(tmp_path / "documents.parquet"))
    left, _ = brute_pipeline(rows, [x for x in items if x[0] is not None], vocabulary)
    assert 0 < len(left) < len(rows) and 9 not in left and 8 in left
    assert result_rows(cp.run(spark, str(tmp_path))) == digests(left)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, wide(rows), str(tmp_path))
        assert out.columns == wide(rows).columns and {(r["_gone"], r["leak"], r["a.b"], r["number"]) for r in out.collect()} == {(1, "x", "y", 2)}
        assert stage(spark, wide([]), str(tmp_path)).count() == 0
    # Repeated and null ids, all columns null: rows count, not ids.
    twice = wide([(None, prose(305, 50)), (None, prose(306, 50)), (20, prose(305, 50)), (20, prose(307, 50)), (20, prose(307, 50)), (None, None)])
    assert sorted((r["doc_id"] is None, r["text"]) for r in cp.near_dedup(spark, twice.filter("text IS NOT NULL"), str(tmp_path)).collect()) == sorted([(False, prose(305, 50)), (False, prose(307, 50)), (True, prose(306, 50))])
    assert cp.quality_rules(spark, twice, str(tmp_path)).count() == 5 and cp.remove_benchmark(spark, twice, str(tmp_path)).count() == 6
    assert cp.tokenize(spark, twice, str(tmp_path)).count() == 6


def test_line_dedup_leaves_only_the_lists(spark, monkeypatch):
    """The tables of lines are gone before the texts move; what is left is the list of each document's lines."""
    made = []

    class Kept(line_dedup.Scratch):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(line_dedup, "Scratch", Kept)
    docs = spark.createDataFrame([(1, "a b c d e f g h\nx"), (2, "a b c d e f g i\ny"), (3, "x\nz")], "doc_id long, text string")
    left = line_dedup.dedup_lines(docs)
    assert [len(s.paths) for s in made] == [1]
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, "a b c d e f g h\nx"), (2, "y"), (3, "z")]

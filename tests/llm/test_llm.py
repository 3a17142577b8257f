"""The training-data operators: SQL, brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parents[2])]

from oracle import same  # noqa: E402

import corpus_pipeline  # noqa: E402
from pulsegrid.llm import bucket_pointer, curriculum, gam, line_quality, line_windows, media, minmax_hash, packing, toxic_segments, url_rules  # noqa: E402
from pulsegrid.llm.common import Scratch, table, training_rows  # noqa: E402
from pulsegrid.llm.components import components  # noqa: E402
from pulsegrid.llm.queries import ORACLE, QUERIES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for c, v in more.items():
        df = df.withColumn(c, F.lit(v))
    return df


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a column that clashes with results."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "a b c d e f g\nh i\nj k\nl", "en", "s", 9),
        (1, "a b c d e f g\nh i\nj k\nl", "en", "s", 9),
        (1, "other text of the same id", None, "s", None),
        (None, "no id", "en", None, 5),
        (None, None, None, None, None),
        (2, None, "en", "s", 0),
        (3, "", "en", "t", 0),
        (4, long, "en", None, len(long)),
        (5, " \t\n ", "en", "t", 4),
        (6, "x", "en", "u", 1),
        (7, "ä 漢字 <|endoftext|> \x00 é", "en", "u", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in ("key", "n_lines", "position", "score", "size", "media", "removed", "row_key", "n_words", "word", "host", "h"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], ORACLE[name])


def test_components_of_chains_and_hubs(spark, scratch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (500, 501)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60)) and got[501] == 500
    assert components(spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0


# -- op1


def test_redirects_propagate_blocks_and_allows(spark, scratch):
    link = lambda to: f"<html><head><link href='{to}' rel=\"canonical\"></head>"
    pages = [
        (1, "https://a.example.com/en/1", None),
        (2, "http://alias.example.info/x", link("https://a.example.com/en/1/")),
        (3, "http://alias2.example.info/y", "<meta http-equiv=refresh content='0; url=http://alias.example.info/x'>"),
        (4, "http://c.example.info/z", link("https://m.example.com/en/77")),
        (5, "http://c.example.info/z2", link("http://c.example.info/z")),
        (6, "https://b.example.com/en/5", link("/fr/9")),
        (7, "https://b.example.com/fr/9", ""),
        (8, None, "<p>"),
        (9, "no scheme", None),
        (10, "HTTP://A.Example.COM/en/2?q#f", None),
        (11, "http://plain.info/", None),
        (11, "http://plain.info/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_rules.judge_urls(df, url_rules.PRODUCTION_RULES, scratch).collect()}
    assert [got[i].verdict for i in range(1, 12)] == ["block", "block", "block", "allow", "allow", "block", "block", "allow", "allow", "block", "allow"]
    assert got[10].host == "a.example.com" and got[10].path == "/en/2" and got[10].rule == "com/en/" and got[9].host == got[8].path == ""
    redirects = spark.createDataFrame([("http://plain.info/", "http://x.org/es/1")], "from_url string, to_url string")
    again = url_rules.judge_urls(df, url_rules.PRODUCTION_RULES, scratch, redirects=redirects)
    assert {r.verdict for r in again.where("page_id = 11").collect()} == {"block"} and again.count() == len(pages)
    assert url_rules.judge_urls(df.limit(0), url_rules.PRODUCTION_RULES, scratch).count() == 0
    con = duckdb.connect()
    con.register("pages", df.drop("host").toPandas())
    want = {(a, b) for a, b in con.execute(f"select page_id, verdict from ({url_rules.oracle()})").fetchall()}
    assert {(r.page_id, r.verdict) for r in got.values()} == want


def test_links_that_are_relative_quoted_or_several(spark, scratch):
    canonical = lambda to: f"<link rel='canonical' href='{to}'>"
    pages = [
        ("http://a.example.info/d/b.html", canonical("c.html"), ["http://a.example.info/d/c.html"]),
        ("http://a.example.info/d/e/b.html?q=1", canonical("../c.html?x=../y#z"), ["http://a.example.info/d/c.html?x=../y#z"]),
        ("http://a.example.info/d/b", canonical("./../../f/./g/"), ["http://a.example.info/f/g/"]),
        ("http://a.example.info", canonical("c.html"), ["http://a.example.info/c.html"]),
        ("http://a.example.info/d/b.html", canonical("?p=2"), ["http://a.example.info/d/b.html?p=2"]),
        ("http://a.example.info/d/b.html", canonical("go?to=http://x.org/"), ["http://a.example.info/d/go?to=http://x.org/"]),
        ("http://a.example.info/d/b.html", canonical("mailto:x@y.org"), []),
        ("http://a.example.info/d/b.html", canonical("//h.org/x"), ["http://h.org/x"]),
        ("http://r.info/1", "<meta http-equiv=\"refresh\" content=\"0; url='http://b.com/en/1'\">", ["http://b.com/en/1"]),
        ("http://r.info/d/2", "<meta http-equiv=refresh content='3;URL=next'><meta http-equiv=refresh content='9; url=/last'>", ["http://r.info/d/next", "http://r.info/last"]),
        ("http://r.info/3", canonical("http://one.info/") + canonical("http://two.info/"), ["http://one.info/", "http://two.info/"]),
        ("http://r.info/4", "<p>none</p>", []),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = sorted((r.a_url, r.b_url) for r in url_rules.link_edges(df, "url", "html").collect())
    assert got == sorted((u, to) for u, _, targets in pages for to in targets)
    alias = spark.createDataFrame([(1, "http://b.com/en/1", None), (2, "http://r.info/1", pages[8][1])], "page_id long, url string, html string")
    assert {r.verdict for r in url_rules.judge_urls(alias, url_rules.PRODUCTION_RULES, scratch).collect()} == {"block"}


def test_sql_resolves_links_as_the_code_does(spark, scratch, tmp_path):
    """Chains, several tags a page, dots, queries and fragments: all columns of the query equal its SQL."""
    link, go = (lambda to: f'<LINK rel=canonical href="{to}">'), (lambda to: f"<meta http-equiv='refresh' content=\"0; url='{to}'\">")
    pages = [
        ("http://a.example.info/d/b.html", link("../c.html") + go("/e/./f/")),
        ("https://a.example.info/c.html", link("//b.net/de/1")),
        ("http://c.info/1?x=1", link("#top") + link("?y=2") + go("http://Shop.Example.com/en/5")),
        ("http://c.info/1?y=2", None),
        ("http://d.info", link("en/1/../2") + link("mailto:a@b.org")),
        ("http://d.info/en/2/", go("../../../../g")),
        ("http://d.info/g?utm_source=q", link("http://d.org/es/7")),
        ("http://e.info/a/b/c", link("..") + go(".") + link("")),
        ("http://e.info/a", link("http://x.com/en/9#part")),
        ("http://e.info/a/b", "<p>plain</p>"),
        ("no address", link("http://x.com/en/9")),
        (None, link("http://x.com/en/9")),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages * 2)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (part,) = (tmp_path / "parts").glob("*.parquet")
    part.rename(tmp_path / "pages.parquet")
    query = lambda s, d: url_rules.judge_urls(s.read.parquet(f"{d}/pages.parquet"), url_rules.PRODUCTION_RULES, scratch).drop("url")
    same(spark, str(tmp_path), query, url_rules.oracle())
    # No page has a rule of its own: the first two reach an allowed host, the last two have no address.
    got = query(spark, str(tmp_path)).collect()
    assert {r.rule for r in got} == {None} and {r.page_id % 12 for r in got if r.verdict == "block"} == set(range(2, 10))


def test_every_address_is_a_component(spark, scratch):
    """Addresses of one node share a decision without any link, tracking parameters name no other page, and rules are many."""
    pages = [
        (1, "https://a.example.com/en/", None),
        (2, "http://a.example.com/en", None),
        (3, "https://b.example.com/de/1?utm_source=feed&p=2", None),
        (4, "http://b.example.com/de/1?p=2", None),
        (5, "http://b.example.com/de/1?ref=x", None),
        (6, None, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("Component", F.lit("clash"))
    many = [(f"h{i}.org", "/", "block") for i in range(6000)] + [("com", "/en/", "block"), ("h7.org", "/x", "allow")]
    got = {r.page_id: r for r in url_rules.judge_urls(df, many, scratch).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 6)] == ["block", "block", "allow", "allow"] and got[2].rule is None and got[6].component is None
    assert got[3].component == got[4].component == "b.example.com/de/1?p=2" and got[5].component == "b.example.com/de/1"
    more = spark.createDataFrame([(1, "http://h5999.org/a", None), (2, "http://h7.org/xy", None), (3, "http://ah7.org/xy", None)], "page_id long, url string, html string")
    assert {r.page_id: r.rule for r in url_rules.judge_urls(more, many, Scratch(spark, "more")).collect()} == {1: "h5999.org/", 2: "h7.org/x", 3: None}


# -- op2


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    d = table(spark, sf_dir, "documents")
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in d.collect()}
    packed = packing.pack(d, BPE).collect()
    back = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert len(part) == r.length == 1 << r.bucket <= 1024 and r.start == len(back.get(r.doc_id, [])) and r.offset == 0
        back.setdefault(r.doc_id, []).extend(part)
    assert back == ids and len({r.sequence_id for r in packed}) == len(packed)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.piece_digests(packing.pack(d, BPE)).collect()}
    assert all(digests[r.doc_id, r.start] == zlib.crc32(r.ids) for r in packed)


def test_encoder_equals_tokenizer():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "12", "!", "é", "\x1c", "\x85", "　", "<|endoftext|>", "word", "\r\n", "\x00", "漢", "🙂"]
    enc = packing.TextEncoder(BPE)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


# -- op3


def test_line_windows(spark, scratch):
    texts = ["1\n2\n3\n4\nx", "y\n1\n2\n3\nz", "2\n3\n4", "\n\n\n\n", "\n\n\n", "1\n2", None, "r\nr\nr\nr\nr"]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_windows.dedupe_lines(docs(spark, texts), scratch).collect()}
    assert got == {0: (texts[0], 0), 1: ("y\nz", 3), 2: ("", 3), 3: (texts[3], 0), 4: (texts[4], 0), 5: ("1\n2", 0), 6: (None, 0), 7: ("r", 4)}


# -- op4


def test_targets_are_filled_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 500, None: 40}
    rows = curriculum.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    got = {r.source: (r.weight, r.target) for r in rows}
    assert {k: v[0] for k, v in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    weights, targets, open_ = {k: v[0] for k, v in got.items()}, {}, set(sizes)
    while open_:
        rest = sum(sizes.values()) - sum(targets.values())
        over = {s for s in open_ if rest * weights[s] / sum(weights[x] for x in open_) > 3 * sizes[s]}
        if not over:
            targets |= {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
            break
        targets |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    assert all(got[s][1] == pytest.approx(t) for s, t in targets.items())


def test_schedule_is_inverted(spark):
    for knots in curriculum.SCHEDULES.values():
        t = [i / 50 for i in range(51)]
        grid = np.linspace(0, 1, 100_001)
        w = np.interp(grid, *zip(*knots, strict=True))
        done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        share = np.interp(t, grid, done / done[-1])
        got = [r[0] for r in spark.createDataFrame([(float(y),) for y in share], "y double").select(curriculum.time_of(F.col("y"), knots)).collect()]
        assert np.allclose(got, t, atol=1e-4)


def test_mix_takes_its_targets_in_order(spark, sf_dir, scratch):
    d = table(spark, sf_dir, "documents")
    plan = curriculum.plan_mix(d, scratch, carry=["source"]).collect()
    taken, most = {}, {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
        assert r.taken <= 3 * r.size and len(r.positions) == r.copies and sorted(r.positions) == r.positions
    assert all(abs(taken[r.source] - r.target) <= most[r.source] for r in plan)
    mixed = curriculum.mix(d, scratch)
    got = [r.position for r in mixed.collect()]
    assert got == sorted(got) and len(got) == sum(r.copies for r in plan)
    assert mixed.columns == [*d.columns, "position"]


def test_shared_and_missing_ids_are_spread(spark, scratch):
    """Rows of one id or of none are dealt over the salts; their words are taken like any others."""
    rows = [(None, f"w{i} " * 5, "en", "s", 1) for i in range(300)] + [(7, "same text", "en", "s", 1)] * 300 + [(i, "a b c", "en", "t", 1) for i in range(100, 200)]
    plan = curriculum.plan_mix(spark.createDataFrame(rows, DOC), scratch, carry=["source"]).collect()
    taken = {s: sum(r.taken for r in plan if r.source == s) for s in "st"}
    target = {r.source: r.target for r in plan}
    assert len(plan) == 700 and all(abs(taken[s] - target[s]) <= 5 for s in "st")


def test_positions_do_not_depend_on_the_splits(spark, tmp_path):
    """Repeated, null and identical rows get the same positions from 1, 4 and 8 files, and op3 and op8 keep the same rows."""
    rnd = random.Random(9)
    rows = [(None if i % 11 == 0 else i % 40, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))), "en", f"s{i % 3}", i % 5) for i in range(1200)]
    rows += [(7, "the same text", "en", "s1", 3)] * 500 + [(8, "three\nlines\nmore\nand", "en", "s1", i % 7) for i in range(60)]
    seen = []
    for n in (1, 4, 8):
        rnd.shuffle(rows)
        path = str(tmp_path / f"split-{n}")
        spark.createDataFrame(rows, DOC).repartition(n).write.parquet(path)
        d = spark.read.parquet(path)
        plan = curriculum.plan_mix(d, Scratch(spark, "plan"), content=["n_chars"], carry=["n_chars", "text"])
        mixed = curriculum.mix(d, Scratch(spark, "mix"))
        near = minmax_hash.near_duplicates(d, Scratch(spark, "near"))
        lines = line_windows.dedupe_lines(d, Scratch(spark, "lines"))
        order = lambda found: sorted(map(repr, found))
        seen.append(
            (
                order((r.doc_id, r.n_chars, r.text, tuple(r.positions)) for r in plan.collect()),
                order((r.position, r.doc_id, r.text, r.n_chars) for r in mixed.collect()),
                order((r.doc_id, r.text, r.n_chars, r.component_id, r.is_first) for r in near.collect()),
                order((r.doc_id, r.text, r.n_chars, r.n_removed) for r in lines.collect()),
            )
        )
    for one, four, eight in zip(*seen, strict=True):
        assert one == four == eight and len(one) > 500
    plan = curriculum.plan_mix(spark.createDataFrame(rows, DOC), Scratch(spark, "sum"))
    found = plan.agg(F.sum("taken"), F.sum("size")).first()
    assert abs(found[0] - found[1]) < 100


def test_schedule_is_sorted_by_position(spark, sf_dir, scratch):
    plan = curriculum.schedule(curriculum.plan_mix(table(spark, sf_dir, "documents"), scratch))
    first = [r.first_position for r in plan.collect()]
    known = [x for x in first if x is not None]
    assert known == sorted(known) and first[: len(known)] == known
    assert "rangepartitioning" in plan._jdf.queryExecution().executedPlan().toString()


# -- op5


def test_segments_are_maximal():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 30)
        hits = [(i, rng.choice([0.3, 1.0, 2.5])) for i in range(n) if rng.random() < 0.3]
        score = [-0.4] * n
        for i, s in hits:
            score[i] += s
        got = toxic_segments.segments(hits, 0.4)

        def best(low, high):
            """Maximal segments by definition: the best one, then those left and right of it."""
            runs = [(sum(score[a : b + 1]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a, high)]
            top = max(((s, w, k, a, b) for s, w, k, a, b in runs if s > 1e-9), default=None)
            if top is None:
                return []
            *_, a, b = top
            return [*best(low, a), (a, b, top[0]), *best(b + 1, high)]

        want = best(0, n)
        assert len(got) == len(want) and math.isclose(sum(s for *_, s in got), sum(s for *_, s in want), abs_tol=1e-9)


def held_out(spark, name, sf_dir, label):
    d = QUERIES[name](spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("y")), "doc_id").where("held_out and y is not null")
    return [(r.y, r.predicted, r.score) for r in d.collect()]




@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxic_segments", "toxic", 0.9), ("op9_pairwise_additive_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    rows = held_out(spark, name, "/root/testdata/sf0.01", label)
    assert sum(y == p for y, p, _ in rows) / len(rows) >= least and all(0 <= s <= 1 for *_, s in rows)


def test_held_out_toxic_documents_are_found(spark):
    rows = held_out(spark, "op5_toxic_segments", "/root/testdata/sf0.01", "toxic")
    found = sum(y == p == 1 for y, p, _ in rows)
    assert found >= 0.8 * sum(y for y, *_ in rows) and found >= 0.9 * sum(p for _, p, _ in rows)


def test_evidence_for_clean_text_counts(spark):
    """Log-odds by hand: words of toxic texts score above 0, words of clean texts alone below it."""
    rows = [(i, f"alpha beta vile{'' if i % 2 else 's'} gamma" if i % 4 == 0 else "alpha beta calm gamma", int(i % 4 == 0)) for i in range(400)]
    model = toxic_segments.fit(spark.createDataFrame(rows, "id long, text string, y int"), "text", "y")
    n_toxic, n_clean, toxic, clean = 100, 300, 0, 300
    prior = 0.5 + (toxic + clean) / 400
    a, b = toxic + prior, clean + prior
    odds, away = math.log(a / (n_toxic + 1)) - math.log(b / (n_clean + 1)), 1.96 * math.sqrt(1 / a + 1 / b)
    assert math.isclose(model.units["calm"], odds + away) and model.units["calm"] < 0 < model.units["viles"]
    assert not {"alpha", "beta", "gamma"} & set(model.units) and not any(u[0] == "^" and v < 0 for u, v in model.units.items())
    assert model.score("calm") < 0 and model.score("calms") == 0 and model.score("vilest") == model.units["^viles"]


def test_background_statistics():
    """Lambda solves the moment equation of the scores; K gives back the number of clean segments at their mean score."""
    scores, shares = np.array([-0.5, 0.0, 1.0, 2.5]), np.array([0.2, 0.75, 0.04, 0.01])
    rate = toxic_segments._rate(scores, shares)
    assert math.isclose((shares * np.exp(rate * (scores - toxic_segments.DRIFT))).sum(), 1, rel_tol=1e-6) and rate > 0.01
    counts, at = np.array([50, 30, 20]), np.array([1.0, 2.0, 3.0])
    k = toxic_segments._chance(at, counts, 1e4, 1.5)
    assert math.isclose(k * 1e4 * math.exp(-1.5 * 1.7), 50) and toxic_segments._chance(at[:0], counts[:0], 1e4, 1.5) == 1e-4
    assert toxic_segments._rate(np.array([-1.0]), np.array([1.0])) == 5.0 and toxic_segments._rate(counts[:0], counts[:0]) == 1.0


def test_passages_by_hand():
    model = toxic_segments.Model({"bad": 2.0, "worse": 3.0, "fine": -3.0}, rate=1.0, k=0.01, bias=-1.0, slope=2.0)
    n, found = model.passages("some bad worse words fine then bad " + "word " * 93)
    want = [(1, 2, 5 - 2 * toxic_segments.DRIFT)]
    assert n == 100 and [(a, b) for a, b, *_ in found] == [(1, 2)] and math.isclose(found[0][2], want[0][2])
    assert math.isclose(found[0][3], want[0][2] - math.log(0.01 * 100 / toxic_segments.SIGNIFICANT))
    assert model.passages("")[1] == [] and model.probability(0.0) == 1 / (1 + math.exp(1.0))


def test_words_with_marks_are_learned_and_found(spark):
    """Combining marks belong to their words on both sides: Hindi, and accents as characters of their own."""
    rng = random.Random(4)
    bad, good = ["घृणित", "मूर्खता", "de\u0301bile", "cre\u0301tin"], ["नदी", "पुस्तक", "fore\u0302t", "jardin", "soleil", "पेड़", "maison", "e\u0301cole"]
    text = lambda toxic: " ".join([rng.choice(good) for _ in range(30)] + ([rng.choice(bad) for _ in range(6)] if toxic else []) + [rng.choice(good) for _ in range(30)])
    df = spark.createDataFrame([(i, text(i % 2), i % 2) for i in range(120)], "doc_id long, text string, y int")
    model = toxic_segments.fit(df, "text", "y")
    assert {u for u in model.units if u[0] != "^"} == set(bad)
    rows = toxic_segments.judge_toxicity(df, model).collect()
    assert all((r.score > 0.5) == bool(r.y) for r in rows) and {r.n_words for r in rows} == {60, 66}
    assert toxic_segments.words_of("Été l'e\u0301te\u0301 2x_y ि") == ["été", "l", "e\u0301te\u0301", "x", "y"]


def test_models_without_labels(spark, scratch):
    d = docs(spark, ["some words", "", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = training_rows(d, labels, scratch, label="toxic", folds=3, held_out=1)
    assert {r.score < 0.5 for r in toxic_segments.judge_toxicity(d, toxic_segments.fit(rows, "t", "y")).collect()} == {True}
    assert gam.judge_quality(d, gam.fit(rows)).count() == 3


# -- op6


def brute_repeats(rows, n=200):
    seen = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for p in range(len(b) - n + 1):
            seen[b[p : p + n]] = seen.get(b[p : p + n], 0) + 1
    out = []
    for i, b in raw:
        cover = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                cover[p] += 1
                cover[p + n] -= 1
        on = np.cumsum(cover[:-1]) > 0
        out.append((i, len(b), int(on.sum()), int((np.diff(np.r_[0, on.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~on])).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_against_brute_force(spark, scratch):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh éß\n") for _ in range(n))
    base = [make(600) for _ in range(6)]
    texts = ["a" * 1000, "ab" * 300, "x" * 199, "x" * 200, "", None, "a" * 250, "abc" * 100 + make(100) + "abc" * 90]
    for _ in range(70):
        a = rng.randrange(300)
        texts.append(make(rng.randrange(150)) + rng.choice(base)[a : a + rng.randrange(150, 330)] + make(rng.randrange(80)) + (rng.choice(base)[rng.randrange(400) :] if rng.random() < 0.3 else ""))
    texts.append(texts[20])
    got = bucket_pointer.span_digests(docs(spark, texts), scratch).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(list(enumerate(texts)))


def test_long_texts_in_parts(monkeypatch):
    raw = np.frombuffer(("".join(random.Random(2).choice("abcd") for _ in range(5000))).encode(), np.uint8)
    pos, _, _, low, high = bucket_pointer.anchors(raw)
    windows = sorted((int(p - o), int(p)) for p, a, b in zip(pos, low, high, strict=True) for o in range(a, b + 1))
    assert [w for w, _ in windows] == list(range(5000 - 199))


# -- op8


def plain_shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark, scratch):
    """A family of near copies of one text, most of which are linked to some but not to all others; copies; short texts."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(200)] = f"w{rng.randrange(30)}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "one two", "One  two", "three", "", None, " \n"]
    got = minmax_hash.near_duplicates(docs(spark, texts), scratch)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute_near(list(enumerate(texts)))
    assert got.where("is_first").count() == got.select("component_id").distinct().count()


def test_blocks_find_every_link():
    import pandas as pd

    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice([w, "q"]) if rng.random() < 0.04 else w for w in base) for _ in range(30)]
    rows = pd.DataFrame({"f": 1, "key": range(30), "c": range(30), "block": 0, "i": 0, "j": 0, "text": texts})
    links = minmax_hash._block_links(rows)
    root = list(range(30))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links.itertuples(index=False):
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {(i, find(i)) for i in range(30)} == {(i, c) for i, _, c in brute_near(list(enumerate(texts)))}


# -- op9


def test_training_by_hand():
    """One feature that decides the label: the first round's table is that of the gradient's best cuts."""
    x = np.array([[0.0], [0.0], [1.0], [1.0]] * 50)
    y = np.array([0.0, 1.0, 1.0, 1.0] * 50)
    model = gam.train(x, y)
    got = model.score(np.array([[0.0], [1.0]]))
    assert abs(got[0] - 0.5) < 0.05 and got[1] > 0.95 and not model.pairs
    g, h = np.array([-9.0, 3.0, 3.0, -9.0]), np.ones(4)
    assert np.allclose(gam.shallow_tree(g, h), [-9 / 3, 6 / 4, 6 / 4, -9 / 3])


def test_scores_are_additions_of_bins():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.train(x, y)
    for row in x[:20]:
        z = model.bias + sum(t[sum(c <= v for c in e)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        z += sum(t[sum(c <= row[i] for c in model.pair_edges[i]), sum(c <= row[j] for c in model.pair_edges[j])] for i, j, t in model.pairs)
        assert math.isclose(model.score(row[None])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    # Neither feature tells anything alone: the pair does.
    assert (1, 0) in {(i, j) for i, j, _ in model.pairs} and ((model.score(x) > 0.5) == y).mean() > 0.95


# -- op10


def test_png_against_a_plain_reader():
    """Chunks by the format's definition, rows unfiltered byte by byte; the hash by sums of cosines."""
    rng = np.random.default_rng(9)
    payload = bytes(rng.integers(32, 127, 64 * 40, np.uint8))
    data, at, body, size = media.encode_png(payload), 8, b"", None
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + part) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        size = (int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big")) if kind == b"IHDR" else size
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows = zlib.decompress(body), []
    for y in range(size[1]):
        line = raw[y * 65 : y * 65 + 65]
        row = []
        for x, v in enumerate(line[1:]):
            left, above = (row[x - 1] if x else 0), (rows[y - 1][x] if y else 0)
            row.append((v + [0, left, above][line[0]]) % 256)
        rows.append(row)
    assert size == (64, 40) and bytes(v for row in rows for v in row) == payload
    bands = [(i * 40 // 32, (i + 1) * 40 // 32) for i in range(32)]
    small = [[np.mean([rows[y][x] for y in range(a, b) for x in (2 * j, 2 * j + 1)]) for j in range(32)] for a, b in bands]
    low = [round(sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)), 4) for u in range(8) for v in range(8)]
    middle = float(np.median(low[1:]))
    bits = "".join("1" if v > middle else "0" for v in low)
    assert media.visual_hash(media.decode_png(data)) == f"{int(bits, 2):016x}"


def test_png_round_trip_and_checks():
    rng = np.random.default_rng(1)
    for n in (64, 640, 64 * 700):
        for payload in (rng.integers(0, 256, n, np.uint8).tobytes(), bytes(n), b"text of some kind " * (n // 18) + bytes(n - 18 * (n // 18))):
            data = media.encode_png(payload)
            assert media.decode_png(data).tobytes() == payload and len(media.visual_hash(media.decode_png(data))) == 16
    broken = bytearray(data)
    broken[60] ^= 1
    for bad in (bytes(broken), data[:50], b"", data[:-12]):
        with pytest.raises(media.MediaError):
            media.decode_png(bad)


def test_png_filters():
    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (12, 64), np.uint8)
    kinds = np.array([0, 1, 2, 2, 3, 4, 4, 1, 2, 3, 0, 4], np.uint8)
    rows = np.empty_like(want)
    for y, k in enumerate(kinds):
        for x in range(64):
            a = int(want[y, x - 1]) if x else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            rows[y, x] = (int(want[y, x]) - [0, a, b, (a + b) // 2, paeth][k]) % 256
    assert np.array_equal(media.unfilter(kinds, rows), want)


def test_media_query(spark, sf_dir):
    text = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in QUERIES["op10_png_media"](spark, sf_dir).collect():
        raw = (text[r.doc_id] or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))


# -- odd inputs


OPERATORS = {
    "pack": lambda d, s: packing.piece_digests(packing.pack(d, BPE)),
    "lines": line_windows.dedupe_lines,
    "plan": curriculum.plan_mix,
    "mix": curriculum.mix,
    "toxicity": lambda d, s: toxic_segments.judge_toxicity(d, toxic_segments.Model({"x": 3.0})),
    "repeats": bucket_pointer.remove_repeats,
    "rules": lambda d, s: line_quality.judge_lines(d),
    "near": minmax_hash.near_duplicates,
    "quality": lambda d, s: gam.judge_quality(d, gam.train(np.zeros((0, len(gam.FEATURES))), np.zeros(0))),
    "media": lambda d, s: media.media_digests(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_inputs(spark, scratch, name):
    d = odd(spark)
    rows = OPERATORS[name](d, scratch).collect()
    assert len(rows) >= d.count() if name in ("pack",) else len(rows) == d.count() or name == "mix"
    assert OPERATORS[name](d.limit(0), Scratch(spark, "none")).count() == 0


def test_odd_inputs_have_defined_results(spark, scratch):
    """Nulls, empty texts, repeated rows and clashing names (in any case) by their values."""
    d = odd(spark)
    for c in ("N_Removed", "Score", "Payload", "Is_First", "Clean_Text", "Removed"):
        d = d.drop(c).withColumn(c, F.lit("clash"))
    by = lambda rows, *c: {r.text: tuple(r[x] for x in c) for r in rows if r.doc_id != 1 and (r.text is None or len(r.text) < 99)}
    lines = line_windows.dedupe_lines(d, scratch)
    assert by(lines.collect(), "n_lines", "n_removed") == {"no id": (1, 0), None: (0, 0), "": (1, 0), " \t\n ": (2, 0), "x": (1, 0), "ä 漢字 <|endoftext|> \x00 é": (1, 0)}
    toxic = toxic_segments.judge_toxicity(d, toxic_segments.Model({"x": 30.0}, k=0.01, bias=-3.0, slope=3.0), keep_text=True)
    got = by(toxic.collect(), "n_words", "score")
    assert got[""] == got[None] == (0, 1 / (1 + math.exp(3.0))) and got["x"][1] > 0.9 and got["x"][0] == 1
    near = minmax_hash.near_duplicates(d, Scratch(spark, "odd")).collect()
    assert by(near, "n_shingles", "component_id")[""] == (0, 3) and by(near, "n_shingles")["no id"] == (1,)
    # Two rows of the same text and id are one class, of which one row is first.
    assert sorted(r.is_first for r in near if r.doc_id == 1 and r.text.startswith("a")) == [False, True]
    spans = bucket_pointer.remove_repeats(d, Scratch(spark, "odd")).collect()
    assert {r.text: bytes(r.kept_bytes) for r in spans if r.text in ("", "x")} == {"": b"", "x": b"x"} and all(bytes(r.kept_bytes) == b"" for r in spans if r.text is None)
    rules = {r.text: r for r in line_quality.judge_lines(d.withColumn("copy", F.col("text"))).withColumnRenamed("copy", "text").collect()}
    assert (rules[None].n_words, rules[None].kept, rules[None].clean_text) == (0, False, "") and rules["no id"].n_words == 2
    stored = media.read_media(media.to_media(d, "text", "media"), "media", "payload", "feature")
    assert {r.text: bytes(r.payload) for r in stored.collect() if r.text in ("", "x")} == {"": bytes(64), "x": b"x" + bytes(63)}
    packed = packing.pack(d, BPE).where("doc_id is null or doc_id in (2, 3)").collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in packed if r.start == 0) == [(0, 1), (0, 3), (2, 1), (3, 1)]


def test_sequences_follow_the_training_order(spark, sf_dir, keep):
    """The packing stage numbers sequences by the place of their document in the written mix."""
    d = table(spark, sf_dir, "documents")
    mixed = keep(curriculum.mix(d, Scratch(spark, "order"), seed="mix").select(*d.columns), "mixed")
    files = sorted({r[0] for r in mixed.select("_metadata.file_name").collect()})
    want = [r.doc_id for r in sorted(mixed.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect(), key=lambda r: (files.index(r.f), r.i))]
    pieces = sorted(corpus_pipeline.pack_tokens(spark, mixed, sf_dir).collect(), key=lambda r: r.sequence_id)
    assert [r.doc_id for r in pieces if r.start == 0] == want
    positions = [r.position for r in curriculum.mix(d, Scratch(spark, "order")).collect()]
    assert positions == sorted(positions) and len(positions) == len(want)


def test_long_words_are_told_apart():
    """Words that agree under a polynomial modulo 2^64 (a Thue-Morse word and its complement)."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert not set(minmax_hash.shingles(f"one {a} two")) & set(minmax_hash.shingles(f"one {b} two"))


def test_repeated_rows_are_defined(spark, scratch):
    d = odd(spark)
    near = minmax_hash.near_duplicates(d, scratch).where("doc_id = 1").collect()
    assert sorted((r.component_id, r.is_first) for r in near) == [(1, False), (1, True), (1, True)]
    lines = line_windows.dedupe_lines(d, scratch).where("doc_id = 1 and text not like 'other%'").collect()
    assert sorted(r.n_removed for r in lines) == [0, 4]


def test_pipeline_against_plain_version(spark, sf_dir, keep):
    d = table(spark, sf_dir, "documents")
    by_stage = []
    for name, stage in corpus_pipeline.STAGES:
        d = keep(stage(spark, d, sf_dir), name)
        by_stage.append(d)
    clean, lines, near, mixed, packed = by_stage
    columns = table(spark, sf_dir, "documents").columns
    assert all(x.columns == columns for x in by_stage[:4])
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    stays = {r.doc_id for r in clean.collect()}
    clean_ids = [i for i, y in labels.items() if y == 0]
    assert sum(i in stays for i in clean_ids) >= 0.97 * len(clean_ids) and sum(i not in stays for i, y in labels.items() if y) >= 0.5 * sum(labels.values())
    seen, want = set(), {}
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        a = (r.text or "").split("\n")
        gone = set()
        for p in range(len(a) - 2):
            w = tuple(a[p : p + 3])
            if not any(WORD.search(x) for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        if len(gone) < len(a) or not gone:
            want[r.doc_id] = "\n".join(x for p, x in enumerate(a) if p not in gone)
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert {r.doc_id for r in near.collect()} == {c for *_, c in brute_near(list(want.items()))}
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3 and set(counts) <= {r.doc_id for r in near.collect()}
    assert packed.agg(F.sum("length")).first()[0] == sum(
        len(packing.encoder(BPE).encode(r.text or "")) // 4 + 1 for r in mixed.collect()
    )
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_pipeline_stages_take_odd_inputs(spark, sf_dir, keep):
    for start in (odd(spark), odd(spark).limit(0)):
        d = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            d = keep(stage(spark, d, sf_dir), name)
            assert i == 4 or d.columns == start.columns

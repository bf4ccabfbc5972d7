"""Each operator against brute force, SQL, a round trip or held-out accuracy, and its defined cases."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest

from chronoloom.llm import decontamination, exact_dedup, license_scan, lm_scoring, near_dedup, packing, quality, registry, suffix_dedup, toxicity, url_filter
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, key string, n long, h long, u long, found_id long, cuts string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4, "z") for i, t in pairs], SCHEMA)


LONG = "Lorem %d ipsum dolor, sit amet. " * 2000 % tuple(range(2000))
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, LONG + "!"), (8, "a b c d e"), (9, "é ñ 日本 \u2028 x"), (None, "one"), (10, "x" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


# exact dedup


def test_exact_dedup_matches_sql(spark, duck):
    got = registry.op7_exact_dedup(spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.sql(registry.SQL["op7_exact_dedup"]).df())


def test_exact_dedup_cases(odd, empty):
    rows = [r.asDict() for r in exact_dedup.exact_groups(odd).collect()]
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["keep_id"] == 2 and by[2]["kept"] and by[4]["group_size"] == 4 and by[4]["keep_id"] == 5 and by[6]["kept"] and by[7]["kept"]
    assert not by[None]["kept"] and by[2]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicate(odd).columns == odd.columns


def test_exact_dedup_with_colliding_hashes(odd):
    want = sorted(map(str, exact_dedup.exact_groups(odd).collect()))
    assert sorted(map(str, exact_dedup.exact_groups(odd, digest=lambda c: len(c) % 2).collect())) == want


def test_cut_points_follow_the_content():
    data = np.frombuffer(LONG.encode() * 40, np.uint8)
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and all(b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends))
    moved = exact_dedup.cut_points(np.concatenate([np.full(700, 65, np.uint8), data]))
    assert len({e - 700 for e in moved} & set(ends)) > len(ends) // 2


# near dedup


def shingles(text):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return sets, label


def test_near_dedup_matches_brute_force(docs, texts):
    sets, label = near_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_groups(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_dedup_open_pairs_of_a_bucket(spark):
    """A chain of near copies whose ends are not alike, and copies of copies."""
    words = [f"w{k}" for k in range(120)]
    chain = {i: " ".join(words[:i] + [f"v{k}" for k in range(i)] + words[2 * i :]) for i in range(0, 12)}
    chain |= {100 + i: t for i, t in chain.items()}
    _, label = near_components(chain)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, chain.items())).collect()}
    assert got == label


def test_near_dedup_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 4)
    rng = np.random.default_rng(5)
    base, some = [f"w{k}" for k in range(150)], {}
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 9))):
            w[at] = f"x{i}-{at}"
        some[i] = " ".join(w)
    _, label = near_components(some)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, some.items())).collect()} == label


def test_near_dedup_finds_pairs_just_above_the_similarity(spark):
    """400 pairs of different texts each, at similarities from 0.75 to 0.80."""
    rng = np.random.default_rng(6)
    some, want = {}, 0
    for k in range(400):
        w = [f"{k}-{x}" for x in rng.integers(0, 10**9, 300)]
        v = list(w)
        for at in rng.choice(np.arange(5, 295, 6), 8, replace=False):
            v[at] = f"{k}-new-{at}"
        a, b = shingles(" ".join(w)), shingles(" ".join(v))
        if 100 * len(a & b) >= 75 * len(a | b):
            want += 1
            some[2 * k], some[2 * k + 1] = " ".join(w), " ".join(v)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, some.items())).collect()}
    assert want == 400 and all(got[2 * k + 1] == 2 * k for k in range(400))


def test_near_dedup_cases(odd, empty):
    rows = near_dedup.near_groups(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3))
    assert by[5]["component_id"] == 4 and by[7]["component_id"] == 6 and near_dedup.near_groups(empty).count() == 0
    assert near_dedup.keep_one_of_each(odd).columns == odd.columns


def test_dedup_stages_keep_null_ids_and_one_of_repeated_rows(spark, odd):
    more = frame(spark, [*ODD, (None, None), (None, "only here, with no id"), (None, "only here, with no id"), (None, "and another"), (11, "twice the same"), (11, "twice the same")])
    left = lambda df: sorted((str(r["doc_id"]), (r["text"] or "")[:8], len(r["text"] or "")) for r in df.collect())
    row = lambda i, t: (str(i), t[:8], len(t))
    shared = [row(3, "   \n\t"), row(6, LONG), row(8, "a b c d e"), row(9, "é ñ 日本 \u2028 x"), row(10, "x" * 3000)]
    extra = [row(None, "only here, with no id"), row(None, "and another"), row(11, "twice the same")]
    assert left(exact_dedup.deduplicate(odd)) == sorted([*shared, row(2, ""), row(5, "one"), row(7, LONG + "!")])
    assert left(exact_dedup.deduplicate(more)) == sorted([*shared, row(2, ""), row(5, "one"), row(7, LONG + "!"), *extra])
    assert left(near_dedup.keep_one_of_each(odd)) == sorted([*shared, row(1, ""), row(2, ""), row(4, "one")])
    assert left(near_dedup.keep_one_of_each(more)) == sorted([*shared, row(1, ""), row(2, ""), row(4, "one"), row(None, ""), *extra])


# suffix dedup


def removed(texts):
    starts = {}
    for i, t in texts:
        for s in range(len(t) - 399):
            starts.setdefault(t[s : s + 400], []).append((i, s))
    gone = {i: np.zeros(len(t), bool) for i, t in texts}
    for places in starts.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + 400] = True
    out = {}
    for i, t in texts:
        g = gone[i]
        spans = int((np.diff(np.concatenate(([0], g.astype(np.int8)))) == 1).sum())
        out[i] = (len(t), int(g.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("most", [512, 2])
def test_suffix_dedup_matches_brute_force(spark, texts, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "BUCKET", most)
    some = {i: t for i, t in texts.items() if len(t) < 6000}
    shared = "".join(chr(97 + (k * k * 7 + k) % 26) for k in range(900))
    some |= {1000 + k: f"{k} start " + shared[k * 7 : 500 + k * 23] + f" end {k} " + "ab" * 300 * (k % 2) for k in range(12)}
    want = removed([(i, t.encode()) for i, t in some.items()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, some.items())).collect()}
    assert got == want


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    rng = np.random.default_rng(12)
    a, b, c = (bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode() for n in (900, 900, 500))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c + "x"), (3, a[:450]), (4, b + a[100:520]), (4, b + a[100:520])]
    want = [removed([(k, t.encode()) for k, (_, t) in enumerate(rows)])[k] for k in range(len(rows))]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, want))


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_deals_a_hot_anchor_out(spark, monkeypatch, seed):
    """A passage in many texts, with different surroundings, cut at any place, and copies that change a byte."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 4)
    rng = np.random.default_rng(seed)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passage, head, some = letters(700), letters(200), []
    for k in range(90):
        lo, hi = int(rng.integers(0, 150)), 700 - int(rng.integers(0, 150))
        part = bytearray(passage[lo:hi])
        if k % 4 == 0:
            part[int(rng.integers(0, len(part)))] = 65
        some.append((k, (letters(int(rng.integers(0, 40))) + (head if k % 3 == 0 else b"") + bytes(part) + letters(int(rng.integers(0, 40)))).decode()))
    want = removed([(i, t.encode()) for i, t in some])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, some)).collect()}
    assert got == want


def test_suffix_dedup_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    rng = np.random.default_rng(1)
    a = bytes(rng.integers(97, 123, 9000, dtype=np.uint8))
    some = [(1, a.decode()), (2, (b"x" + a[2500:6200]).decode())]
    off = np.array([0, 9000, 9000 + 3701])
    pieces = suffix_dedup._pieces(off)
    windows = sorted((r, s) for r, lo, hi in pieces for s in range(lo, hi - 399))
    assert windows == sorted({(0, s) for s in range(8601)} | {(1, 9000 + s) for s in range(3302)})
    want = removed([(i, t.encode()) for i, t in some])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, some)).collect()}
    assert got == want


def test_suffix_sort_orders_windows():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 600, dtype=np.uint8)
    at = np.arange(560)
    order = suffix_dedup.SuffixSort(data, 40).sort(at, np.zeros(560, np.int64), np.full(560, 560))
    raw = data.tobytes()
    assert [raw[k : k + 40] for k in order] == sorted(raw[k : k + 40] for k in at)


def test_suffix_dedup_cases(odd, empty):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ODD) and suffix_dedup.remove_repeats(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_bytes"] == 0 and by[10]["n_removed"] == 3000 and by[10]["n_spans"] == 1 and by[4]["n_removed"] == 0


# packing


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.vocabulary())
    rows = packing.pack_documents(docs, registry.vocabulary()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), 2048)) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_the_program_makes_the_plan_of_many_items():
    """The more items a length has, the less rounding costs: the program's plan needs fewer than best-fit alone."""
    c, count = 2048, lambda configs: sum(k for _, k in configs)
    sizes = np.minimum(np.random.default_rng(5).lognormal(6, 1, 1000).astype(int) + 1, c)
    for times in (20, 1000):
        demand = np.bincount(sizes, minlength=c + 1) * times
        found, share = packing.plan(demand, c)
        bound, plain = -(-int((demand * np.arange(c + 1)).sum()) // c), count(packing.best_fit(demand, c))
        print(times, bound, count(found), plain, round(share, 4))
        assert bound <= count(found) <= plain and share > 0.9
        assert sum(n * k for held, k in found for n in held.values()) == demand.sum()
    assert count(found) < plain


def test_priced_configurations_weigh_most():
    """Against every multiset of lengths that fits."""
    from itertools import combinations_with_replacement

    rng, c = np.random.default_rng(1), 12
    for _ in range(20):
        weights = np.where(rng.random(c + 1) < 0.5, rng.random(c + 1), -1.0)
        weights[0] = 0.0
        want = max([0.0] + [sum(weights[s] for s in held) for m in range(1, c + 1) for held in combinations_with_replacement(np.flatnonzero(weights > 0).tolist(), m) if sum(held) <= c])
        got = list(packing.priced(weights, c))
        assert (not got and want == 0) or abs((got[0] * weights).sum() - want) < 1e-9
        assert all((x * np.arange(c + 1)).sum() <= c for x in got) and (np.sum([x > 0 for x in got], axis=0) <= 1).all()


def test_path_rules_of_nested_hosts_against_all_rules():
    """Each page of many hosts, with the rules of the hosts around it held once and searched from where the last page was."""
    rng = np.random.default_rng(2)
    path = lambda: "/" + "".join(rng.choice(list("ab/"), rng.integers(0, 7)))
    hosts = ["com", "a.com", "b.a.com", "b.com"]
    rules = {(h, p): url_filter.Rule(h, p, "block") for h, p in ((str(rng.choice(hosts)), path()) for _ in range(150))}.values()
    pages = sorted({(url_filter.turned(h), h, path()) for h in [*hosts, "c.a.com", "net", "x.b.a.com"] for _ in range(60)})
    rows = sorted([(url_filter.turned(r.host), 0, r.path, r.host) for r in rules] + [(k, 1, p, h) for k, h, p in pages])
    of, sweep, now, paths, found = {(r.host, r.path): r for r in rules}, url_filter.HostSweep(), None, None, 0
    for key, kind, p, host in rows:
        if kind == 0:
            sweep.add(key, of[host, p])
            continue
        if key != now:
            now, paths = key, url_filter.PathSweep(sweep.rules_at(key))
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and p.startswith(r.path)]
        want = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
        assert paths.winner(p) == want
        found += want is not None
    assert 100 < found < len(pages)


def test_plans_never_need_more_than_best_fit():
    """Five histograms of lengths; the program's own share of the sequences, and where it needs fewer."""
    rng, c = np.random.default_rng(0), 2048
    sizes = {
        "long tail": np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, c),
        "halves, quarters": np.concatenate([np.full(900, 1040), np.full(900, 520), np.full(1800, 500), np.full(900, 700)]),
        "hard for best-fit": np.concatenate([np.full(600, 1031), np.full(600, 559), np.full(600, 538), np.full(1200, 479)]),
        "a third to a half": rng.integers(400, 1000, 5000),
        "three classes": np.concatenate([rng.integers(1025, 1100, 2000), rng.integers(560, 620, 2000), rng.integers(330, 460, 2000)]),
    }
    count, saved, shares = lambda configs: sum(k for _, k in configs), {}, {}
    for name, of in sizes.items():
        demand = np.bincount(of, minlength=c + 1)
        found, shares[name] = packing.plan(demand, c)
        got = np.zeros(c + 1, np.int64)
        for held, k in found:
            assert sum(x * n for x, n in held.items()) <= c
            for x, n in held.items():
                got[x] += n * k
        assert (got == demand).all()
        saved[name] = count(packing.best_fit(demand, c)) - count(found)
    print({n: (saved[n], round(shares[n], 2)) for n in sizes})
    assert min(saved.values()) >= 0 and saved["hard for best-fit"] > 100 and saved["halves, quarters"] > 50 and shares["hard for best-fit"] > 0.9


def test_packing_cases(odd, empty):
    rows = packing.pack_documents(odd, registry.vocabulary()).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert packing.pack_documents(empty, registry.vocabulary()).count() == 0


def test_encoder_equals_the_tokenizer():
    e = packing.WordEncoder(registry.vocabulary())
    for s in ("a\tb  c\u00a0d\x85e", "İstanbul ΣΊΓΜΑΣ ﬁ e\u0301x J\u030c", "x<|endoftext|>y <|startoftext|> z", "日本語" * 60, "it's don't 123abc \x1cq", "", " \n ", "\u0301lead Ⅷ² ½"):
        assert e.encode(s) == e.whole(s), s


# url filter


def test_url_filter_matches_sql(spark, duck):
    assert rows_of(registry.op8_url_filter(spark, SF).toPandas()) == rows_of(duck.sql(registry.SQL["op8_url_filter"]).df())


def test_url_filter_cases(spark):
    urls = [None, "no scheme", "http://", "HTTP://WWW.Example.ORG/en/12?q", "x://example.org/en/2#f", "a://notexample.org/es/", "a://b.com/fr/x", "a://com", "a://b.com?x/fr/", "a://example.org/es/\n", "a://org//"]
    pages = spark.createDataFrame([(k % 7, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    rules = registry.URL_RULES
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect())
    want = []
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        want.append((k % 7, host, path, best.text if best else "", best.verdict if best else "allow"))
    assert got == sorted(want)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_url_filter_joins_a_table_of_many_rules(spark):
    """Nested rules over hosts and paths, one host and one url with a third of the pages each, more ranges than rules a range."""
    rng = np.random.default_rng(5)
    names = ["a", "b", "a-b", "c", "\u00e9", "zz"]
    host = lambda most: ".".join(rng.choice(names, rng.integers(1, most)))
    path = lambda most: "/" + "/".join(rng.choice(["x", "y", "xx", ""], rng.integers(0, most)))
    rules = {(host(4), p if (p := path(4)) != "/" else ""): str(rng.choice(["allow", "block"])) for _ in range(400)}
    urls = [f"h://{host(6)}{path(5)}" for _ in range(600)] + [f"h://c.b.a{path(6)}" for _ in range(600)] + ["h://b.a/x/y/xx"] * 600
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(7)
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, table.union(table), default="none").collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        h, _, rest = u[4:].partition("/")
        fit = [(len(rh + rp), len(rh), rh + rp, v) for (rh, rp), v in rules.items() if ("." + h).endswith("." + rh) and ("/" + rest).startswith(rp)]
        best = max(fit, default=(0, 0, None, "none"))
        assert got[k] == best[2:], u


def test_url_filter_refuses_a_rule_without_host(spark):
    pages = spark.createDataFrame([(1, "a://b/")], "page_id long, url string")
    with pytest.raises(Exception, match="needs a host"):
        url_filter.filter_urls(pages, [url_filter.Rule("", "/x", "block")]).collect()


# decontamination


def test_decontamination_finds_planted_items(spark, texts):
    items = [(1, "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the attic of an old house."), (2, "short"), (3, None), (4, "")]
    edited = items[0][1].replace("quick", "quik").replace("seven", "sevn").replace("old", "odl")
    clean = next(t for t in texts.values() if len(t) > 3000)
    cases = [(1, clean + "\n" + items[0][1].upper().replace(" ", "  ") + clean), (2, "start " + edited + " end"), (3, clean), (4, items[0][1][:60]), (5, None), (6, items[0][1][::-1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(frame(spark, cases), bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {1, 2} and got[1]["min_edits"] == 0 and 1 <= got[2]["min_edits"] <= decontamination.budget(len(items[0][1]))
    assert list(got[1]["items"]) == [1] and got[3]["n_items"] == 0
    kept = decontamination.decontaminate(frame(spark, cases), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns[:2] == ["doc_id", "text"]


def test_decontamination_contains_every_exact_item(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: decontamination.normalise(r["text"]) for r in bench.collect()}
    want = {i: [b for b, t in sorted(items.items()) if len(t) >= 24 and t in decontamination.normalise(d)] for i, d in texts.items()}
    got = {r["doc_id"]: set(r["items"]) for r in decontamination.contamination(docs, bench).collect()}
    assert all(set(want[i]) <= got[i] for i in want) and sum(bool(v) for v in got.values()) <= sum(bool(v) for v in want.values()) + 2


def test_lemma_bound_loses_no_alignment():
    rng = np.random.default_rng(5)
    item = "".join(rng.choice(list("abcdef ghij"), 150)).strip()
    index = decontamination.Index.of([1], [decontamination.normalise(item)])
    k = int(index.edits[0])
    for _ in range(30):
        t = list(decontamination.normalise(item))
        for _ in range(k):
            at, what = int(rng.integers(len(t))), int(rng.integers(3))
            t[at : at + 1] = [] if what == 0 else ["q"] if what == 1 else [t[at], "q"]
        text = "zz " * 20 + "".join(t) + " yy" * 20
        found = decontamination.search([decontamination.normalise(text)], index, index.table())
        assert found and found[0][3] <= k


def test_overlapping_bands_lose_no_start():
    """Random edits within the budget, at every start modulo the step of the bands."""
    rng = np.random.default_rng(9)
    for m in (24, 26, 29, 32, 36, 39, 40, 60):
        item = "".join(rng.choice(list("abcdefghijklmnop"), m))
        index = decontamination.Index.of([1], [item])
        table, k = index.table(), int(index.edits[0])
        for start in range(2 * k + 1):
            for _ in range(120):
                t = list(item)
                for _ in range(k):
                    at, what = int(rng.integers(len(t))), int(rng.integers(3))
                    t[at : at + 1] = [] if what == 0 else ["q"] if what == 1 else [t[at], "q"]
                found = decontamination.search(["z" * (40 + start) + "".join(t) + "y" * 40], index, table)
                assert found and found[0][3] <= k, (m, start, "".join(t))


def test_decontamination_judges_rows_and_short_and_long_items(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(900)]
    long = " ".join(words)
    bench = spark.createDataFrame([(1, "What is 2+2? Four."), (2, long), (2, long), (3, "yes"), (None, "an item that has no id at all"), (4, "y" * 300), (5, "  \n")], "item_id long, text string")
    rows = [(1, "so: what is 2+2?  four. "), (1, "a clean text"), (None, "so what is 2+2? fourth"), (None, "oh YES, it is"), (2, "eyes on yesterday"), (3, "x " + " ".join(words[200:420]) + " x"), (4, "here is an item that has no id at all."), (5, "y" * 4000), (6, long)]
    want = {(1, 0): [1], (1, 1): [], (None, 0): [], (None, 1): [3], (2, 0): [], (3, 0): [2], (4, 0): [None], (5, 0): [4], (6, 0): [2]}
    for most in (4_000_000, 500):
        monkeypatch.setattr(decontamination, "MOST_HITS", most)
        got = sorted((str(r["doc_id"]), r["contaminated"], r["n_items"], list(r["items"])) for r in decontamination.contamination(frame(spark, rows), bench).collect())
        assert got == sorted((str(i), bool(v), len(v), [x for x in v if x is not None]) for (i, _), v in want.items())
    kept = decontamination.decontaminate(frame(spark, rows), bench).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(i), t) for (i, t), v in zip(rows, want.values()) if not v)


def test_decontamination_blocks_fit_a_task(spark):
    bench = spark.createDataFrame([(k % 7, f"item number {k} of the benchmark, with some words") for k in range(300)] + [(1, "z" * 5000), (1, "z" * 5000)], "item_id long, text string")
    parts = list(decontamination.item_blocks(bench, "item_id", "text", most=2000))
    assert sum(len(ids) for ids, _ in parts) == 301 and all(sum(map(len, texts)) <= 4000 for _, texts in parts)


def test_decontamination_cases(spark, odd, empty):
    bench = spark.createDataFrame([(1, "Lorem 5 ipsum dolor, sit amet. Lorem 6 ipsum dolor")], "item_id long, text string")
    rows = decontamination.contamination(odd, bench).collect()
    assert len(rows) == len(ODD) and {r["doc_id"] for r in rows if r["contaminated"]} == {6, 7}
    assert decontamination.contamination(empty, bench).count() == 0 and decontamination.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


# quality, toxicity


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_scores_are_calibrated_on_unseen_rows(spark):
    """In bands of the score, the share of good rows among held-out ones is near the mean score."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(spark.read.parquet(f"{sf}/documents.parquet"), labels, "quality")
    rows = got.join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").select("score", "quality").toPandas()
    assert abs(rows["score"].mean() - rows["quality"].mean()) < 0.03
    for lo, hi in ((0, 0.3), (0.7, 1.01)):
        band = rows[(rows["score"] >= lo) & (rows["score"] < hi)]
        assert abs(band["score"].mean() - band["quality"].mean()) < 0.08  # ridges of three folds err more than the final one
    assert ((rows["score"] >= 0.3) == (rows["quality"] == 1)).mean() > 0.98


def test_isotonic_never_falls():
    steps = quality.isotonic(np.array([1.0, 2, 0, 1, 4]), np.array([1.0, 0, 0, 1, 2]))
    assert [s[1] for s in steps] == sorted(s[1] for s in steps) and sum(s[0] for s in steps) == 8


def toxic_rows(n=240):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioulrst"), 5)) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [str(x) for x in rng.choice(words, 60)]
        if i % 3 == 0:
            for at in rng.integers(0, 60, 3):
                w[at] = "zxqv" + w[at]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows


def test_toxicity_reads_unseen_words_by_their_characters(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, [(i, t) for i, t, _ in rows]), labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_toxicity_learns_from_a_bounded_number_of_bytes(spark, monkeypatch):
    """Too long texts are passed over, and no more bytes of a kind are learned from than the bound."""
    docs = spark.createDataFrame([(k, f"w{k % 2} " * (1000 if k in (1, 2) else 10)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, share: seen.append((texts, y)))
    monkeypatch.setattr(toxicity, "LONGEST", 100)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 165)
    toxicity.fit(docs, labels, "toxic", "doc_id", "text")
    texts, y = seen[0]
    assert [len(t) for t in texts] == [30] * 10 and y.sum() == 5 and all(t.split()[0] == b"w%d" % k for t, k in zip(texts, y))


def test_toxicity_training_holds_a_block_of_texts_at_a_time(monkeypatch):
    """The words, 4-grams and windows of many texts are those of the joined text, which is never held."""
    from chronoloom.llm.common import BLOCK, spaced

    rows = toxic_rows(300)
    texts = [b"", *((t + " ").encode() * 25 for _, t, _ in rows), b"one", b" ."]
    assert sum(map(len, texts)) > 2 * BLOCK
    whole = toxicity.Words(*spaced(np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)))
    read = []

    class Seen(toxicity.Words):
        def __init__(self, data, starts):
            read.append(len(data))
            super().__init__(data, starts)

    monkeypatch.setattr(toxicity, "Words", Seen)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 4)
    toxicity.train(texts, np.array([0, *(y for _, _, y in rows), 0, 0]), 0.3, epochs=4)
    assert max(read) <= BLOCK + len(texts)
    joined = toxicity.JoinedWords(texts)
    for name in ("keys", "ptr", "grams", "of", "cut", "first"):
        assert np.array_equal(getattr(joined, name), getattr(whole, name)), name
    windows, real = joined.cut_out(np.arange(joined.first[-1]))
    assert np.array_equal(windows, whole.windows) and np.array_equal(real, whole.real)


def test_toxicity_gradients():
    rows = toxic_rows(12)
    texts = [t.encode() for _, t, _ in rows]
    from chronoloom.llm.common import spaced

    w = toxicity.Words(*spaced(np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)))
    net = toxicity.Network(w.keys, np.unique(w.grams), np.random.default_rng(0))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    wr, gr = net.rows(w)
    chosen, y = np.arange(4), np.array([0.0, 1, 1, 0])
    none = type("R", (), {"random": staticmethod(lambda n: np.ones(n))})
    g = net.gradients(w, wr, gr, chosen, y, np.ones(4), none)

    def loss():
        z = net.run(net.gates(net.inputs(w, wr, gr)), w.windows[chosen], w.real[chosen]).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for k in ("va", "wo", "Uf", "Wb", "cf"):
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-2
        up = loss()
        net.p[k][at] -= 2e-2
        down = loss()
        net.p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_classifier_cases(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (quality.score(odd, labels, "quality").collect(), toxicity.score(odd, labels).collect()):
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in quality.score(odd, none, "quality").collect()} == {0.5} and toxicity.keep_clean(odd, none).count() == len(ODD)
    assert quality.score(empty, labels, "quality").count() == 0 and toxicity.score(empty, labels).count() == 0


# licences


def test_licence_scan_finds_notices(docs, texts):
    notices = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit"}
    want = {i: sorted({f for n, f in notices.items() if n in t}) for i, t in texts.items()}
    assert {r["doc_id"]: list(r["families"]) for r in license_scan.scan(docs).collect()} == want


def test_licence_scan_cases(spark, empty):
    cases = [(1, None), (2, ""), (3, "licence"), (4, "Released under the MIT License.\nx"), (5, "Licensed under the terms of the vendor agreement."), (5, "nothing here"), (6, "plain text of no interest\n" * 50)]
    rows = license_scan.scan(frame(spark, cases)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(cases) and list(by[4]["families"]) == ["mit"] and sorted(r["n_unknown"] for r in rows if r["doc_id"] == 5) == [0, 1] and not by[6]["families"] and not by[1]["families"]
    assert license_scan.scan(empty).count() == 0


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
MIT = """# Permission is hereby granted, free of charge,
# to any person obtaining a copy of
# this software and associated documentation files"""


def test_licence_scan_reads_wrapped_notices(spark):
    nc = "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0\nInternational License, see there."
    plain = "plain text of no interest\nin lines\n \t\nand another run"
    cases = [(1, "Some title\n\n" + GPL + "\n\n" + plain), (2, MIT + "\n\n" + plain), (3, nc), (4, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (5, plain), (6, GPL + "\n \n" + MIT), (None, GPL)]
    cases += [(10 + k, plain) for k in range(30)]
    by = {r["doc_id"]: r for r in license_scan.scan(frame(spark, cases)).collect()}
    got = {i: (list(by[i]["families"]), by[i]["n_confirmed"]) for i in (1, 2, 3, 4, 5, 6, None)}
    assert got == {1: (["gpl-3.0"], 1), 2: (["mit"], 1), 3: (["cc-by-nc-4.0"], 1), 4: (["apache-2.0", "mit"], 1), 5: ([], 0), 6: (["gpl-3.0", "mit"], 2), None: (["gpl-3.0"], 1)}


def test_licence_scan_tells_rows_of_one_id_apart(spark):
    part = "licensed under the GNU General Public"
    plain = [(100 + k, f"ordinary words of text {k}") for k in range(20)]
    rows = [(1, part), (1, part), (1, part), (None, "Released under the MIT License."), (None, "Licensed under CC BY-SA 4.0."), (2, "Released under the MIT License."), (2, "nothing of the kind"), *plain]
    got = sorted((str(r["doc_id"]), list(r["families"])) for r in license_scan.scan(frame(spark, rows)).collect() if r["doc_id"] is None or r["doc_id"] < 100)
    assert got == sorted([("1", []), ("1", []), ("1", []), ("None", ["mit"]), ("None", ["cc-by-sa-4.0"]), ("2", ["mit"]), ("2", [])])


def test_licence_scan_reads_wordings_it_has_not_seen(spark):
    unseen = {
        1: ("The code in this folder is licensed under the Apache License, Version 2.0 by its authors.", "apache-2.0"),
        2: ("Redistribution and use in source and binary forms, with or without modification, is permitted to all.", "bsd-3-clause"),
        3: ("These notes are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License by us.", "cc-by-nc-4.0"),
        4: ("Slides: licensed under CC BY-SA 4.0, please share alike.", "cc-by-sa-4.0"),
        5: ("The tool is free software under the terms of the GNU General Public License version 3 as it stands.", "gpl-3.0"),
        6: ("All of this is licensed under the MIT License, enjoy.", "mit"),
    }
    plain = {100 + k: f"ordinary words of text {k}, under the roof of the house" for k in range(20)}
    got = {r["doc_id"]: list(r["families"]) for r in license_scan.scan(frame(spark, [*((i, t) for i, (t, _) in unseen.items()), *plain.items()])).collect()}
    assert got == {i: [f] for i, (_, f) in unseen.items()} | {i: [] for i in plain}


def test_licence_scan_confirms_no_relative(spark):
    rivals = [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This program is licensed under the GNU Affero General Public License, version 3 or later",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Licensed under the BSD 2-Clause License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under the Apache License, Version 1.1.",
        "This package is not released under the MIT License.",
        "The code is no longer licensed under the Apache License, Version 2.0.",
    ]
    right = {100: ("Licensed under the BSD 3-Clause License.", "bsd-3-clause"), 101: ("GNU General Public License, version 3 or later", "gpl-3.0"), 102: ("Creative Commons CC BY-SA 4.0", "cc-by-sa-4.0")}
    rows = [*enumerate(rivals), *((i, t) for i, (t, _) in right.items()), *((i, f"plain words of text number {i}") for i in range(200, 230))]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert {i: list(r["families"]) for i, r in got.items() if r["families"]} == {i: [f] for i, (_, f) in right.items()}
    # rivals are seen as notices of no known family
    assert sum(got[i]["n_unknown"] for i in range(len(rivals))) >= len(rivals) - 2


def test_licence_features_are_counted_over_all_paragraphs(spark):
    from pyspark.sql import functions as F

    order = [r["id"] for r in spark.range(400).orderBy(F.xxhash64("id"), "id").collect()]
    plain = [f"words of paragraph {k}" for k in range(9)]
    text = lambda k: "they said hereby granted once" if k < 30 else "a redistribution and more" if k >= 300 else "nothing"
    docs = frame(spark, [(i, "\n\n".join([*plain, text(k)])) for k, i in enumerate(order)])
    grams = {r["gram"] for r in license_scan.fit(docs, "doc_id", "text").grams.collect()}
    rare, common = (spark.range(1).select(license_scan.bigrams(F.lit(t))[0]).first()[0] for t in ("hereby granted", "redistribution and"))
    # 30 and 100 of 4000 paragraphs; all 30 and none of the 100 are in the first 200 documents
    assert rare in grams and common not in grams


def test_licence_patterns_run_once_a_text(spark):
    plain = " ".join(f"word{k}" for k in range(4000))
    rows = [(k, f"Title of {k}\n{plain}\nReleased under the MIT License.") for k in range(30)] + [(100 + k, plain) for k in range(30)]
    docs = frame(spark, rows)
    model = license_scan.fit(docs.limit(1), "doc_id", "text")
    began = time.monotonic()
    got = {(r["id"], r["family"], r["confirmed"]) for r in license_scan.classify(docs, model).collect()}
    assert got == {(k, "mit", True) for k in range(30)}
    # patterns over all of a text for each of its bigrams take minutes here
    assert time.monotonic() - began < 45


# language model


def test_lm_prefers_text_like_its_corpus(spark):
    rng = np.random.default_rng(4)
    pairs = [(a, b) for a, b in zip([f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)])]
    text = lambda: " ".join(w for k in rng.integers(0, 30, 60) for w in pairs[k])
    rows = [(i, text()) for i in range(300)]
    shuffled = rows[0][1].split()
    rng.shuffle(shuffled)
    rows.append((1000, " ".join(shuffled)))
    got = {r["doc_id"]: r for r in lm_scoring.score(frame(spark, rows)).collect()}
    assert got[0]["mean_log_likelihood"] > got[1000]["mean_log_likelihood"] and got[0]["n_tokens"] == 120


def test_lm_gradients():
    rng = np.random.default_rng(6)
    net = lm_scoring.WindowNetwork(np.ones(lm_scoring.TOKENS))
    tokens = rng.integers(0, lm_scoring.TOKENS, 40)
    ctx = lm_scoring.contexts(tokens, np.array([0, 25, 40]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.gradients(ctx, tokens)
    for k in ("E", "W", "b", "C", "V", "v"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += 1e-3
        up = -net.log_probabilities(ctx, tokens).mean()
        net.p[k][at] -= 2e-3
        down = -net.log_probabilities(ctx, tokens).mean()
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3 + 0.02 * abs(g[k][at]), k


def test_lm_cases(odd, empty):
    rows = lm_scoring.score(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) and by[1]["n_tokens"] == 0 and by[1]["log_likelihood"] == 0 and by[1]["mean_log_likelihood"] is None
    assert lm_scoring.score(empty).count() == 0


@pytest.mark.parametrize("common", [200_000, 700, 0])
def test_lm_rates_rare_words_by_their_own_counts(spark, monkeypatch, common):
    """Against brute force: the network's value and each rare word's share of its token."""
    monkeypatch.setattr(lm_scoring, "COMMON", common)
    rng = np.random.default_rng(8)
    rows = [(i % 50, " ".join(f"w{k}" for k in rng.zipf(1.2, 200) % 6000)) for i in range(60)] + [(None, "w1 w2"), (None, "")]
    texts = lm_scoring.id_text(frame(spark, rows), "doc_id", "text")
    words, net, counts = lm_scoring.fit(texts)
    n_of = {r["h"]: r["n"] for r in counts.collect()}
    asked = [*rows, (77, "never seen words here")]
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_likelihood"], 3)) for r in lm_scoring.score(frame(spark, asked), model=(words, net, counts)).collect())
    want, unseen = [], 0
    for i, t in asked:
        h, _ = lm_scoring.word_hashes(np.frombuffer(t.encode(), np.uint8))
        tokens = words.tokens(h)
        total = net.log_probabilities(lm_scoring.contexts(tokens, np.array([0, len(h)])), tokens).sum() if len(h) else 0.0
        for x, k in zip(h[tokens >= lm_scoring.KNOWN].view(np.int64), tokens[tokens >= lm_scoring.KNOWN]):
            unseen += int(x) not in n_of
            share = n_of.get(int(x), 1 / (words.distinct[k - lm_scoring.KNOWN] + 1))
            total += np.log(share / (words.counts[k] + 1))
        want.append((str(i), len(h), round(float(total), 3)))
    assert unseen == 4 and words.distinct.sum() > 100 and len(words.common[0]) <= common
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 0.05


# pipeline


def test_pipeline_matches_brute_force(spark, docs, texts):
    import corpus_pipeline

    toxic = {r["doc_id"] for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    left = {i: t for i, t in texts.items() if i not in toxic}
    last = {}
    for i, t in left.items():
        last[t] = max(i, last.get(t, i))
    left = {i: t for t, i in last.items()}
    _, label = near_components(left)
    left = {i: t for i, t in left.items() if label[i] == i}
    found = {r["id"] for r in decontamination.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(left) - found
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]

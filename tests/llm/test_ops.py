"""The ten operators on hard small tables, each against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltbed.llm import classifier, html_text, jaccard, media, mixing, packing, rollups, rules, substrings, token_output
from siltbed.llm.shared import fresh_path
from siltbed.llm.tokens import WordTokenizer, default_path

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, gram string, mix_size int, open string"


def made_texts():
    rng = random.Random(5)
    words = ["Alpha", "beta,", "gamma", "delta.", "über", "naïve", "1.5", "it's", "汉字", "🙂", "###", "OK!!"] + [f"w{i}" for i in range(400)]
    long_ = " ".join(rng.choice(words) for _ in range(6000))
    base = [rng.choice(words) for _ in range(150)]
    near = base[:]
    near[70] = "changed"
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", " \n\t ", "one", "two words", "a b c d e", "A B C D E", long_, long_, " ".join(base), " ".join(near), "\n".join(near), "x" * 500, "ab" * 300]
    texts += [" ".join(rng.choice(words) for _ in range(80)) + " " + passage + "\n" + " ".join(rng.choice(words) for _ in range(80)) for _ in range(8)]
    texts += ["same line\n" * 40, " lead  double \n\n trail ", "tab\tand vt\x0bff\x0c"] + [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 4, 5, 6, 7, 30, 49, 50, 51, 200)]
    return texts


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, [None, "en", "de"][i % 3], [None, "b", "a", "ä"][i % 4], None, "x", "y", 7, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def by_id(texts):
    return {i * 3 + 1: t or "" for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def ids_of(by_id):
    tok = Tokenizer.from_file(default_path())
    return {k: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in by_id.items()}


def test_tokenizer_equals_library(texts):
    tok, own = Tokenizer.from_file(default_path()), WordTokenizer(default_path(), keep=50)
    hard = ["a\nb c\nD,! x\n'll y\n1", "foo\nbar\n", "\nfoo", "x\n\ny z", "x \ny", "a 　b", "w \x85z", "x\x1c y", "it's' we'll 'x a!!'s", "᠎a b"]
    for t in [t or "" for t in texts] + hard:
        assert own.id_arrays([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_mixing(docs, none, by_id):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(by_id)
    size = {k: len(W.findall(t)) for k, t in by_id.items()}
    total = Counter()
    for r in got:
        assert r["mix_size"] == size[r["doc_id"]] and 0 <= r["mix_copies"] <= 2 and r["size"] == "x"
        total[r["source"]] += r["mix_size"] * r["mix_copies"]
    sums = {}  # what whole documents can reach
    for r in got:
        here = sums.setdefault(r["source"], {0})
        base = int(r["mix_target"] // r["mix_source_size"])
        assert r["mix_copies"] in (base, base + 1)
        here |= {s + r["mix_size"] for s in here}
    for r in got:
        extra = r["mix_target"] % r["mix_source_size"]
        best = min(abs(s - extra) for s in sums[r["source"]])
        assert abs(total[r["source"]] - r["mix_target"]) <= best + 40
    again = {(r["doc_id"], r["mix_copies"]) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["mix_copies"]) for r in got}
    assert mixing.mix_sources(none).count() == 0


def test_water_fill_and_fit():
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 45, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.water_fill([0, 5], [3, 1], 7.5, 2) == [0, 7.5]
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 900, 12))
        counts = rng.integers(1, 9, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        taken = mixing.fit(lengths, counts, budget)
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach |= {s + n * k for s in reach for k in range(c + 1) if s + n * k <= budget}
        assert (taken <= counts).all() and (taken >= 0).all() and max(reach) - 40 <= (lengths * taken).sum() <= budget


def test_fit_with_long_documents():
    one = np.ones(2, np.int64)
    assert mixing.nearest(np.array([180_000, 190_000]), one, 200_000).tolist() == [0, 1]
    assert mixing.fit(np.array([150_000, 170_000]), np.array([2, 1]), 300_000).tolist() == [2, 0]
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(40_000, 250_000, 8))
        counts = rng.integers(1, 3, len(lengths))
        for budget in rng.integers(0, (lengths * counts).sum() + 1, 3).tolist():
            taken = mixing.fit(lengths, counts, budget)
            reach = {0}
            for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
                reach |= {s + n * k for s in reach for k in range(c + 1) if s + n * k <= budget}
            few = budget <= 8 * lengths.max()
            assert (taken <= counts).all() and (taken >= 0).all() and max(reach) - (0 if few else 0.001 * budget) <= (lengths * taken).sum() <= budget


def brute_repeats(texts, width):
    seen, out = set(), {}
    for key, t in sorted(texts.items()):
        raw = t.encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                covered[i : i + width] = b"\1" * width
            seen.add(w)
        out[key] = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
    return out


@pytest.mark.parametrize(("width", "gram"), [(100, 24), (40, 8), (30, 30)])
def test_repeats(docs, none, by_id, width, gram):
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in substrings.remove_repeats(docs, carry=("gram", "size"), width=width, gram=gram).collect()}
    want = brute_repeats(by_id, width)
    assert got == {k: (len(by_id[k].encode()), v) for k, v in want.items()}
    assert substrings.remove_repeats(none).count() == 0


def test_repeats_by_whole_characters(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("äöü汉🙂") for _ in range(80))
    df = spark.createDataFrame([(1, "x€" + body + "é"), (2, "y" + body[3:] + "è")], "doc_id long, text string")
    for r in substrings.remove_repeats(df, width=30, gram=8, chars=True).collect():
        bytes(r["kept"]).decode()


def test_classifier(spark, docs, none):
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["the", "of", "river", "stone", "walks", "green", "tall"]) for _ in range(60)) + "." for _ in range(120)]
    junk = ["### " * 40 if i % 2 else "BUY!! NOW!! " * 20 for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(plain + junk)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(900, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classifier.quality_scores(df, labels).collect()}
    assert len(got) == 182 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [k for k in range(180) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k, r in got.items() if r["held_out"] and k < 180} == set(held)
    assert sum(got[k]["predicted"] == int(k < 120) for k in held) >= 0.95 * len(held)
    flat = classifier.quality_scores(docs, labels.where("doc_id < 0")).collect()
    assert len({r["score"] for r in flat}) == 1
    assert classifier.quality_scores(none, labels).count() == 0


def test_classifier_learns_from_all_pairs(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(150):
        y = int(rng.random() < 0.6)
        words = ["the", "river", "stone.", "walks", "green"] + ["BUY!!", "###", "|"] * (1 if y else 2)
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))))
        labels.append(y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["score"] for r in classifier.quality_scores(df, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")).orderBy("doc_id").collect()]
    every = np.array([classifier.features(t) for t in texts])
    known = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(150)])
    x, y = every[known], np.array(labels)[known]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((every - mean) / scale, -6, 6)
    good, bad = z[known][y == 1], z[known][y == 0]
    d = (good[:, None, :] - bad[None, :, :]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(d @ w)))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 2.5e-5 * np.eye(len(w)), d.T @ (1 - p) / len(d) - 2.5e-5 * w)
    s = z @ w
    logit = np.log(got) - np.log1p(-np.array(got))
    assert np.abs((logit - logit.mean()) - (s - s.mean())).max() < 0.02
    ordered, share = np.sort(s[known]), (y == 0).mean()
    n = len(ordered)
    threshold = (ordered[int(share * (n - 1))] + ordered[int((share + 0.02) * (n - 1))]) / 2
    assert np.abs(logit - (s - threshold)).max() < 0.03


def test_nth_value(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, -1.5, rng.gauss(0, 1), rng.gauss(5, 1e-9)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for rank in (0, 700, 1500, 2999):
        assert classifier.nth(df, rank, buckets=7, small=3) == sorted(values)[rank]


def brute_counts(t):
    words = W.findall(t)
    lines = [x for x in t.split("\n") if W.search(x)]
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def brute_bits(texts):
    """Interpolated modified Kneser-Ney over characters, with dictionaries."""
    def syms(t):
        return [0, 0] + [max(2, ord(x)) for x in t] + [1]

    c3 = Counter(g for t in texts if t for s in [syms(t)] for g in zip(s, s[1:], s[2:], strict=False))
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter(c for _, c in c2)

    def level(counts, context):
        n = [sum(1 for v in counts.values() if v == k) for k in range(1, 5)]
        if min(n) == 0:
            d = [0.5, 1.0, 1.5]
        else:
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(hi, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k, hi in ((1, 0.95), (2, 1.9), (3, 2.9))]
        total, cut = Counter(), Counter()
        for g, v in counts.items():
            total[context(g)] += v
            cut[context(g)] += d[min(v, 3) - 1]
        return (lambda g: (counts[g] - d[min(counts[g], 3) - 1]) / total[context(g)] if g in counts else 0.0), (lambda h: cut[h] / total[h] if total[h] else 1.0)

    s3, l3 = level(c3, lambda g: g[:2])
    s2, l2 = level(c2, lambda g: g[0])
    s1, l1 = level(c1, lambda g: ())
    p1 = lambda c: s1(c) + l1(()) / len(c1)
    p2 = lambda b, c: s2((b, c)) + l2(b) * p1(c)
    p3 = lambda a, b, c: s3((a, b, c)) + l3((a, b)) * p2(b, c)
    return {t: -float(np.mean([np.log2(p3(*g)) for s in [syms(t)] for g in zip(s, s[1:], s[2:], strict=False)])) for t in set(texts) if t}


@pytest.mark.parametrize("limit", [rules.BROADCAST_BYTES, -1])
def test_rules(docs, none, by_id, monkeypatch, limit):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(rules, "BLOCK_BYTES", 20_000)
    got = {r["doc_id"]: r for r in rules.quality_rules(docs, carry=("doc_id", "size", "lang")).collect()}
    assert len(got) == len(by_id)
    bits = {lang: brute_bits([by_id[k] for k, r in got.items() if r["lang"] == lang]) for lang in (None, "en", "de")}
    for k, t in by_id.items():
        r = got[k]
        want = brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])
        assert r["bits_per_char"] == pytest.approx(bits[r["lang"]].get(t, 0.0), abs=1e-4)
    assert rules.quality_rules(none).count() == 0


def test_rules_reject_by_band(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice(["ri", "ver", "sto", "ne", "walk", "gre", "en"]) for _ in range(3)) for _ in range(150)]
    plain = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(60)]
    odd = "".join(chr(rng.randrange(33, 120)) + (" " if i % 5 == 4 else "") for i in range(300))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*plain, odd])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rules.quality_rules(df, upper=3.0, lower=6.0).collect()}
    assert max(got, key=lambda k: got[k]["bits_per_char"]) == 60 and not got[60]["kept"] and not got[60]["base_failed"]
    assert sum(got[k]["kept"] for k in range(60)) >= 54


def test_rules_reject_bad_documents_by_default(spark):
    """On labelled documents that weren't used to choose the band."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.quality_rules(docs).where("NOT base_failed").join(labels, "doc_id").select("doc_id", "quality", "kept").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 2]
    bad, good = ([r["kept"] for r in held if r["quality"] == q] for q in (0, 1))
    assert len(bad) >= 8 and sum(bad) <= 0.3 * len(bad) and sum(good) >= 0.93 * len(good)


def test_byte_coding():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_output.decode(*token_output.encode(values), n) == values).all()


def test_token_files(spark, docs, none, ids_of, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_DOCS", 10)
    path = token_output.write_token_files(docs, fresh_path(spark, "t"))
    ranks = {r["id"]: r["rank"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    counts = Counter(int(i) for x in ids_of.values() for i in x)
    assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(counts, key=lambda i: (-counts[i], i))
    at = 0
    for r in sorted(token_output.read_token_files(spark, path).collect(), key=lambda r: r["doc_id"]):
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids_of[r["doc_id"]]), ids_of[r["doc_id"]].tobytes())
        at += r["n_tokens"]
    assert at == sum(map(len, ids_of.values()))
    assert token_output.token_files(none).count() == 0


def test_html(spark):
    page = (
        "<body><header><h1>Site</h1></header><ul class='menu'><li>a</ul><main><article class=post><header><h1>T &amp; U</h1><span>by x</span></header><p>One\n\ttwo<p>Three<aside>no</aside>"
        "<script>var t='</p>';</script><div class='comments'><article>c1</article></div></article></main><div id='cookie-notice'>x</div><form>f</form><!-- c --></body>"
    )
    bare = "<body><p>Home</p><p>{}</p><p>&copy; us</p></body>"
    rows = [(1, "http://a.org/x/1", page), (2, "http://b.org/n/1?q", bare.format("Real <b>one</b>")), (3, "http://b.org/n/2#t", bare.format("Other")), (4, None, None), (5, "http://c.org/", ""), (6, "http://d.org/x", "plain &lt;text&gt;"), (7, "http://a.org/x/1", page), (8, "http://e.org", "<article><p>cut o")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(df.coalesce(1)).collect()}
    assert got == {1: "T & U\nOne two\nThree", 2: "Real one", 3: "Other", 4: "", 5: "", 6: "plain <text>", 7: "T & U\nOne two\nThree", 8: "cut o"}
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_pages_are_dealt_compressed(by_id):
    import pyarrow as pa

    pages = ["<article><p>" + "</p><p>".join(t.split("\n")) + "</p></article>" for t in by_id.values() if t] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(["u"] * len(pages)), pa.array(pages, pa.string())], ["page_id", "url", "html"])
    dealt = [p for b in html_text._parse([batch]) for p in b.column(2).to_pylist()]
    want = [html_text._coded(html_text.lines(x or "")) for x in pages]
    assert sum(map(len, dealt)) < 0.7 * sum(len(x.encode()) for x in want)
    assert [html_text._unpacked(p) for p in dealt] == want


def test_html_doubtful_names_inside_an_article(spark):
    """A part of a class or id isn't enough to delete what stands inside an article; a line of the nearest page is."""
    page = "<article><h1>T{0}</h1><div class='related-work'><p>Work {0}</p><p>See also our shop</p></div><p id='comment-on-x'>On x {0}</p><p class='social-history big'>History {0}</p><div class='ad-slot-1'>Buy {0}</div><div class='comments'>c {0}</div><p>See also our shop</p></article>"
    df = spark.createDataFrame([(k, f"http://e.org/a/{k}", page.format(k)) for k in (1, 2)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(df).collect()}
    assert got == {k: f"T{k}\nWork {k}\nOn x {k}\nHistory {k}\nSee also our shop" for k in (1, 2)}


def test_html_does_not_depend_on_partitions(spark):
    """Pages without a marked article, in hosts of one to three pages, over more partitions than hosts."""
    rng = random.Random(8)
    rows = []
    for host in range(12):
        for page in range(rng.randrange(1, 4)):
            path = f"{rng.choice('ab')}/{page}"
            rows.append((len(rows), f"http://h{host:02}.org/{path}", f"<p>Menu {host}</p><p>Part {path[0]} of {host}</p><p>Text {len(rows)}</p><p>End {host}</p>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = []
        for n in (1, 2, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, html_text.extract_main_text(df).collect())))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got[0]) == len(rows) and any("Menu" not in r[2] for r in got[0])
    assert got[1] == got[0] and got[2] == got[0] and got[3] == got[0]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        found = sorted(html_text.shared(a, b))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


@pytest.mark.parametrize("limit", [media.BROADCAST_BYTES, -1])
def test_media(spark, docs, none, by_id, monkeypatch, limit):
    monkeypatch.setattr(media, "BROADCAST_BYTES", limit)
    store = media.store_media(docs)
    made = {bytes(r["payload"]): r for r in store.payloads().collect()}
    for r in store.lists.collect():
        raw = by_id[r["doc_id"]].encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert r["n_bytes"] == len(raw) and bytes(made[hashlib.sha256(payload).digest()]["samples"]) == payload
    chunks = [bytes(d) for r in store.lists.select("payload", "digests").distinct().collect() for d in r["digests"]]
    stored = store.stored.where("digest IS NOT NULL").select("digest").collect()
    assert sorted(bytes(r["digest"]) for r in stored) == sorted(d for d, n in Counter(chunks).items() if n > 1)
    assert media.store_media(none).payloads().count() == 0


def test_packing(docs, none, ids_of):
    got = packing.pack_sequences(docs, size=64, open_windows=3).toPandas()
    for key, g in got.sort_values("start").groupby("doc_id"):
        assert b"".join(g["ids"]) == ids_of[key].tobytes() and (g["doc_tokens"] == len(ids_of[key])).all()
        assert (g["start"] == g["length"].cumsum() - g["length"]).all()
    assert set(got["doc_id"]) == set(ids_of)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
        n = g["length"].sum()
        assert n <= 64 and (g["padded_length"] == (n if n & (n - 1) == 0 else 64)).all()
    assert packing.check_padding(got) < 0.02
    assert packing.pack_sequences(none).count() == 0


def brute_components(by_id):
    sets = {}
    for k, t in by_id.items():
        w = W.findall(t.translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {k: k for k in sets}
    while True:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
        if not changed:
            return {k: (len(s), comp[k]) for k, s in sets.items()}


def test_jaccard(spark, docs, none, by_id):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()} == brute_components(by_id)
    rng = random.Random(8)
    cases = {}
    for i in range(300):
        n = rng.randrange(5, 60)
        words = [f"v{rng.randrange(30)}" for _ in range(n)] if i % 3 else cases[rng.choice(list(cases))].split() if cases else ["v"]
        if i % 3 == 0 and len(words) > 8:
            words[rng.randrange(len(words))] = f"z{i}" if i % 2 else words[0]
            words = words[: len(words) - rng.randrange(3)]
        cases[1000 - i] = " ".join(words)
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df).collect()} == brute_components(cases)
    assert jaccard.similar_documents(none).count() == 0


def test_signatures_meet():
    """Sets at the threshold always share a signature that neither may ignore."""
    rng = np.random.default_rng(9)
    scheme = jaccard.PartEnum()
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        k = len(a) // 9 if rng.random() < 0.5 else 0
        b = np.unique(np.concatenate([a[: len(a) - k], rng.integers(0, 1 << 63, k if rng.random() < 0.7 else 0, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 5 * both < 4 * (len(a) + len(b) - both):
            continue
        sa, sb = ({band: (free, set(s.tolist())) for band, free, s in scheme.signatures(x)} for x in (a, b))
        order = lambda s: sorted(s, key=lambda x: hash((x, 1)))  # noqa: E731  any common order
        keep = lambda free, s: set(order(s)[free:])
        assert any(keep(*sa[band]) & keep(*sb[band]) for band in set(sa) & set(sb))


def test_rollups(spark, docs, none, by_id, texts):
    path = fresh_path(spark, "r")
    counts = rollups.with_token_count(docs.select("doc_id", "source", "lang", "text"), "n")
    half = counts.where("doc_id < 40")
    rollups.commit(rollups.inserts(half, "v1", F.col("n")), path, 1)
    rollups.commit(rollups.inserts(counts.where("doc_id >= 40"), "v1", F.col("n")), path, 2)
    for _ in range(2):
        rollups.commit(rollups.revisions(half, "v1", F.col("n"), F.col("n") + 1), path, 3)
    rollups.commit(rollups.deletes(counts.where("lang = 'de'"), "v1", F.when(F.col("doc_id") < 40, F.col("n") + 1).otherwise(F.col("n"))), path, 4)
    rollups.commit(rollups.inserts(none.withColumn("n", F.lit(0)), "v2", F.col("n")), path, 5)
    tok = Tokenizer.from_file(default_path())
    want = Counter()
    for i, t in enumerate(texts):
        if i % 3 != 2:
            n = len(tok.encode(t or "", add_special_tokens=False).ids) + (i * 3 + 1 < 40)
            want[([None, "b", "a", "ä"][i % 4], [None, "en", "de"][i % 3])] += n
    assert {(r["source"], r["lang"]): r["tokens"] for r in rollups.totals(spark, path).collect()} == dict(want)


def test_rollups_broken_commit_and_changes(spark, monkeypatch):
    """A commit that is lost before its marker never counts; revisions and deletes take the store's own old counts."""
    path = fresh_path(spark, "r")
    kind = "doc_id long, source string, lang string, tokenizer string, tokens long"
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    got = lambda: {(r["source"], r["tokenizer"]): (r["documents"], r["tokens"], r["last_batch"]) for r in rollups.totals(spark, path).collect()}
    assert got() == {}
    with monkeypatch.context() as m:
        m.setattr(rollups, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            rollups.change(rows((1, "a", "en", "v", 10)), path, 1)
    assert got() == {}
    rollups.change(rows((1, "a", "en", "v", 10), (2, "a", "en", "v", 5), (None, None, None, "v", 7)), path, 1)
    rollups.change(rows((9, "a", "en", "v", 99)), path, 1)  # the batch is there
    assert got() == {("a", "v"): (2, 15, 1), (None, "v"): (1, 7, 1)}
    rollups.change(rows((1, "b", "en", "v", 11), (3, "a", "en", "v", None)), path, 2)
    assert got() == {("a", "v"): (1, 5, 2), ("b", "v"): (1, 11, 2), (None, "v"): (1, 7, 1)}
    rollups.change(rows((None, "z", None, "v", None), (2, "a", "en", "v", 6)), path, 3)
    assert got() == {("a", "v"): (1, 6, 3), ("b", "v"): (1, 11, 2)}


def test_first_words_are_encoded_once(monkeypatch):
    tok = WordTokenizer(default_path())
    calls, raw = [], tok._raw
    monkeypatch.setattr(tok, "_raw", lambda piece: calls.append(piece) or raw(piece))
    texts = [f"The word{i % 7}. {'x' * i}" for i in range(1, 50)]
    for _ in range(2):
        got = list(tok.ids_bytes(texts))
        assert got == [np.array(e.ids, tok.dtype).tobytes() for e in Tokenizer.from_file(default_path()).encode_batch(texts, add_special_tokens=False)]
    assert calls.count("The") == 1

"""URL filters, quality rules, line dedup and mixing against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from canopyframe.llm import line_dedup, mixing, quality_rules, url_filters

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def judged_by_hand(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(LOW)
    best = None
    for rule, say in rules:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, say)
    return host, path, best and best[0], best[1] if best else "block" if host in listed else "allow"


@pytest.mark.parametrize("max_bits", [url_filters.MAX_BITS, 256])
def test_urls(spark, max_bits, monkeypatch):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q", "http://example.net/EN/", "http://example.net", "x://org/fr/", "x://notorg/fr/",
            "http://b.org/fr#t", "http://c.org/fr/1", "http://example.com/de/", "http://h://y/z", "http://a.b/c\nd", *[f"http://h{i}.test/{i}" for i in range(300)]] * 2
    listed = {f"h{i}.test" for i in range(0, 300, 7)} | {"a.b"}
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id bigint, url string, _listed int")
    want = {i: judged_by_hand(u, RULES, listed) for i, u in enumerate(urls)}
    hosts = {w[0] for w in want.values()}
    universe = spark.createDataFrame([(h, h in listed) for h in hosts], "key string, listed boolean")
    kept = url_filters.listed_keys
    monkeypatch.setattr(url_filters, "listed_keys", lambda *a: kept(*a, max_bits=max_bits))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, RULES, universe).collect()}
    assert got == want


def test_no_urls(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    universe = spark.createDataFrame([], "key string, listed boolean")
    assert url_filters.judge(none, RULES, universe).count() == 0


def base_by_hand(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def histograms(text, lang):
    text = text or ""
    classes = [len(re.findall(c, text)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]", "[#*$%&|<>]", r"[^\x00-\x7F]|[\x00-\x08\x0E-\x1F\x7F]", r"[\x20\x09-\x0D]")]
    w = [x.lower() for x in words(text)]
    common = quality_rules.COMMON_WORDS.get(lang)
    hist = [w.count(c) for c in common] if common else None
    return classes, hist and [*hist, len(w) - sum(hist)]


def js(p, q):
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nansum(p * np.log2(2 * p / (p + q))) + np.nansum(q * np.log2(2 * q / (p + q)))
    return math.sqrt(max(0.0, d / 2))


def check_rules(docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    refs = defaultdict(lambda: [np.zeros(7), np.zeros(9)])
    for r in rows:
        if r.lang in quality_rules.COMMON_WORDS and not base_by_hand(r.text)[-1]:
            c, h = histograms(r.text, r.lang)
            refs[r.lang][0] += c
            refs[r.lang][1] += h
    want = Counter()
    for r in rows:
        base = base_by_hand(r.text)
        c, h = histograms(r.text, r.lang)
        far = 0 if r.lang not in refs or sum(c) < quality_rules.MIN_CHARS_FOR_CLASSES else js(c, refs[r.lang][0])
        odd = 0 if r.lang not in refs or base[0] < quality_rules.MIN_WORDS_FOR_COMMON else js(h, refs[r.lang][1])
        want[(r.doc_id, *base, not base[-1] and far <= quality_rules.MAX_CLASS_DISTANCE and odd <= quality_rules.MAX_WORD_DISTANCE)] += 1
    got = Counter(tuple(r) for r in quality_rules.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    assert got == want


def test_rules(docs, odd_docs, no_docs):
    check_rules(docs)
    check_rules(odd_docs)
    assert quality_rules.judged(no_docs).count() == 0
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_rules_judge_rows_not_keys(spark, docs):
    """Rows without a key stay if they are clean; of rows that repeat a key only the clean ones stay."""
    clean = docs.filter("lang = 'en'").join(quality_rules.accepted(docs).select("doc_id"), "doc_id", "left_semi").select("text").first().text
    rows = [(None, clean, "en"), (None, "short", "en"), (None, None, "en"), (1, clean, "en"), (1, "short", "en"), (1, "again and again " * 60, "en"), (2, "short", "en")]
    got = quality_rules.accepted(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert Counter(tuple(r) for r in got) == Counter([rows[0], rows[3]])


def test_rules_are_native(docs):
    plan = quality_rules.judged(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def lines_by_hand(rows, min_docs, min_chars):
    key = lambda x: x.strip(SPACE).translate(LOW)
    where = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                where[key(x)].add(i)
    gone = {k: max(d) for k, d in where.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = Counter()
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if i is None or gone.get(key(x), i) == i]
        out[i, len(parts), len(parts) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bits", [None, 1 << 17])
def test_lines(docs, odd_docs, no_docs, bits, monkeypatch):
    if bits:  # a filter that is much too small must not change the result
        monkeypatch.setattr(line_dedup, "bits_for", lambda rows: bits)
    for d in (docs, odd_docs):
        got = line_dedup.drop_shared_lines(d, 5, 40, "n_lines", "n_dropped")
        rows = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect())
        assert rows == lines_by_hand([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], 5, 40)
    plain = line_dedup.drop_shared_lines(odd_docs)
    assert plain.columns == odd_docs.columns and plain.filter("key = 'key'").count() == odd_docs.count()
    assert line_dedup.drop_shared_lines(no_docs).count() == 0


def by_hand_count(rate, u):
    n, p = 0, math.exp(-rate)
    c = p
    while c <= u and n < 500:
        n += 1
        p *= rate / n
        c += p
    return n


def test_mixing(spark, odd_docs, no_docs):
    rates = spark.createDataFrame([("a", 0.0), ("b", 2.5), ("hot", 40.0), (None, 1.0)], "source string, rate double")
    got = mixing.replicate(odd_docs, rates, copy="copy")
    assert got.columns == [*odd_docs.columns, "copy"]
    seen = defaultdict(list)
    for r in got.collect():
        seen[r.doc_id, r.source, r.text].append(r["copy"])
    of = {"a": 0.0, "b": 2.5, "hot": 40.0, None: 1.0}
    for r, times in Counter(tuple(x) for x in odd_docs.select("doc_id", "source", "text").collect()).items():
        # A row without a key draws by its text.
        own = "~" + hashlib.md5((r[2] or "").encode()).hexdigest() if r[0] is None else r[0]
        u = int(hashlib.md5(f"17:{own}".encode()).hexdigest()[:13], 16) / 2**52
        assert sorted(seen[r]) == sorted(list(range(by_hand_count(of[r[1]], u))) * times)
    assert mixing.replicate(no_docs, mixing.temperature_rates(no_docs)).count() == 0


def test_mixing_at_high_rates(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 = 0, 'tiny', 'small') as source", "'x' as text")
    rates = spark.createDataFrame([("tiny", 150.0), ("small", 64.5)], "source string, rate double")
    counts = mixing.replicate(docs, rates).groupBy("source", "doc_id").count().collect()
    for source, rate, n in (("tiny", 150.0, 1000), ("small", 64.5, 3000)):
        c = np.array([r["count"] for r in counts if r.source == source])
        assert len(c) == n and abs(c.mean() - rate) < 5 * math.sqrt(rate / n) and abs(c.var() / rate - 1) < 0.25
    huge = spark.createDataFrame([("tiny", 20_000.0)], "source string, rate double")
    assert abs(mixing.replicate(docs.filter("doc_id < 8"), huge).count() / 2 - 20_000) < 700
    # A source of one short text beside a large corpus.
    one = spark.range(3).selectExpr("id as doc_id", "if(id = 0, 'short', 'long' || id) as source", "if(id = 0, 'x', repeat('long text ', 1000000)) as text")
    assert mixing.replicate(one, mixing.temperature_rates(one)).filter("source = 'short'").count() > 64


def test_mixing_hits_its_rates(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "if(id % 4 = 0, 'rare', 'common') as source", "'x' as text")
    rates = spark.createDataFrame([("rare", 3.0), ("common", 0.5)], "source string, rate double")
    n = {r.source: r["count"] for r in mixing.replicate(docs, rates).groupBy("source").count().collect()}
    assert abs(n["rare"] / 10_000 - 3) < 0.06 and abs(n["common"] / 30_000 - 0.5) < 0.02
    with pytest.raises(Exception, match="repetition rate"):
        mixing.replicate(docs, spark.createDataFrame([("rare", 1e6)], "source string, rate double")).count()

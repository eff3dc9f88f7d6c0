"""Each operator against a brute-force version, on rows with every odd case."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import common, decontaminate, jaccard, langid, linededup, mixing, pii, shuffle, sstable, topk, warc
from sightline.llm.queries import tokenizer_path

from .conftest import rows_of

WS = r"[^\x20\x09-\x0D]+"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


# ---------------------------------------------------------------- 1 token shards


def test_word_encoder_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer_path()), sstable.WordEncoder(tokenizer_path())
    texts = [r[1] for r in rows_of() if r[1] and len(r[1]) < 5000] + ["It's 12,5%  they'LL  x\x1cy\x85z<|endoftext|> áe\r\n\tΣΑΣ İ" + "w" * 300, "́ x ́", "don 't", "Été, ÀÉÎ. naïve? ÿ| thé| Ünï;: a\u0301 A\u0301, \u212b ﬁ ª", "a\u000bb\u000cc"]
    r = np.random.default_rng(2)
    bits = ["A", "b", "é", "É", "ß", "×", "÷", "ÿ", "1", "23", ".", ",!", "'s", "'", "<", "<|endoftext|>", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "中文", "한", "\u0301", "İ", "Σ", "€", "¿", "½", "\x00", "😀"]
    texts += [None, ""] + ["".join(r.choice(bits, int(r.integers(1, 30)))) for _ in range(1500)]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for chunk in (1 << 24, 300):
        sstable_chunk(monkeypatch, chunk)
        assert [x.tolist() for x in own.encode_all(pa.array(texts, pa.string()))] == want
        assert [x.tolist() for x in own.encode_all(pa.array(["x", *texts], pa.string()).slice(1), 7)] == [w + [7] for w in want]
    assert list(own.encode_all(pa.array([], pa.string()))) == [] and own.encode(texts[0]).tolist() == want[0]


def sstable_chunk(monkeypatch, size):
    monkeypatch.setattr(sstable, "CHUNK", size)


def test_token_shards(spark, docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    manifest = sstable.write_shards(docs, tokenizer_path(), docs_per_shard=20).cache()
    got = sorted((tuple(r) for r in sstable.read_shards(manifest).collect()), key=lambda r: r[1])
    ids = [(r[0], lib.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows_of()]
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids)
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got)
    known = [r[0] for r in got if r[0] is not None]
    assert known == sorted(known)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    shards = [sstable.Shard(r.path) for r in manifest.collect()]
    for doc_id in (5, None, 203, 999):
        found = sorted(tuple(x.tolist()) for s in shards for x in s.get(doc_id))
        assert found == sorted(tuple(i) for d, i in ids if d == doc_id)
    assert sstable.read_shards(sstable.write_shards(none, tokenizer_path())).count() == 0


def test_shard_of_many_blocks(tmp_path):
    writer = sstable.ShardWriter(f"file://{tmp_path}/a.sst", 49_408, block_bytes=64)
    for k in range(500):
        writer.add(sstable.key_of(k // 2 - 60), np.arange(k % 7, dtype=np.uint32))
    assert writer.close()["n_blocks"] > 10
    shard = sstable.Shard(f"file://{tmp_path}/a.sst")
    for k in range(250):
        assert [len(x) for x in shard.get(k - 60)] == [2 * k % 7, (2 * k + 1) % 7]
    assert shard.get(10_000) == []
    assert sum(shard.may_hold(sstable.key_of(k)) for k in range(1000, 2000)) < 60


# ---------------------------------------------------------------- 2 Jaccard join


def brute_classes(rows, width, percent, roots=None):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(WS, low(text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    if roots is not None:
        roots.update((find(i) if sets[i] else (r[0], r[1])) for i, r in enumerate(rows))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def linked_rows(seed, n=160):
    r = np.random.default_rng(seed)
    base = [[f"w{x}" for x in r.integers(0, 400, size)] for size in r.integers(3, 120, 12)]
    common = [f"c{x}" for x in range(40)]
    out = []
    for i in range(n):
        w = list(base[r.integers(0, len(base))])
        for _ in range(r.integers(0, 4)):
            w[r.integers(0, len(w))] = f"e{r.integers(0, 30)}"
        if r.random() < 0.4:
            w += common
        out.append((int(i * 7 % n), " ".join(w), "en", "s", None, None))
    return out


@pytest.mark.parametrize(("width", "percent", "limits"), [(3, 90, (32, 1024)), (3, 90, (3, 12)), (5, 80, (2, 6)), (1, 80, (3, 12))])
def test_jaccard(spark, docs, none, monkeypatch, width, percent, limits):
    monkeypatch.setattr(jaccard, "RARE", limits[0])
    monkeypatch.setattr(jaccard, "VERY", limits[1])
    for rows in (rows_of(), linked_rows(width * percent + limits[0])):
        df = docs if len(rows[0]) == 6 and rows[0][1] == rows_of()[0][1] else spark.createDataFrame(rows, docs.schema)
        got = jaccard.Join(df, width, percent).result().select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_classes(rows, width, percent), key=key)
    assert jaccard.Join(none, width, percent).result().count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (1, 80)])
def test_jaccard_links(spark, docs, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard, "RARE", 3)
    monkeypatch.setattr(jaccard, "VERY", 12)
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    rows = rows_of() + [(1000 + r[0], *r[1:]) for r in linked_rows(width * percent + 3)]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if (w := re.findall(WS, low(r[1] or ""))) else set() for r in rows]
    want = [(r[0], sum(bool(x and y) and i != j and 100 * len(x & y) >= percent * len(x | y) for j, y in enumerate(sets))) for i, (r, x) in enumerate(zip(rows, sets, strict=True))]
    got = jaccard.Join(spark.createDataFrame(rows, docs.schema), width, percent).links().collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def meet(x, y, classes, percent):
    """Whether the index lets two sets meet: a token alone, or a combination that their rare tokens allow."""
    (ax, tx, rx, _), (ay, ty, ry, _) = (jaccard.combinations(v, classes, percent) for v in (x, y))
    most = min(jaccard.bounds(len(v), percent)[1] for v in (x, y))
    return np.intersect1d(ax, ay).size or (rx + ry <= most and np.intersect1d(tx, ty).size)


def test_small_prefixes_meet():
    """From the least size on: every class assignment, with a token of any class put in anywhere."""
    for percent, sizes in ((80, (4, 5, 6)), (90, (9,))):
        assert sizes[0] == 100 // (100 - percent) - 1
        for n in sizes:
            for kinds in itertools.product((1, 2, 3), repeat=n) if n < 9 else [(3,) * 9, (2,) + (3,) * 8, (2, 2) + (3,) * 7]:
                x = np.arange(10, 10 * n + 10, 10).astype(np.uint64)
                classes = dict(zip(x.tolist(), kinds, strict=True))
                for at, kind in itertools.product(range(n + 1), (1, 2, 3)):
                    y = np.sort(np.append(x, np.uint64(10 * at + 5)))
                    assert meet(x, y, classes | {10 * at + 5: kind}, percent)


def test_prefixes_meet():
    """Linked sets share an indexed combination, whatever the classes are."""
    r = np.random.default_rng(1)
    for percent in (80, 90):
        for _ in range(1200):
            n = int(r.integers(9, 90))
            x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
            gone = int(r.integers(0, jaccard.bounds(len(x), percent)[0] + 1))
            y = np.unique(np.concatenate([r.permutation(x)[gone:], r.integers(0, 1 << 62, int(r.integers(0, 4))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both < percent * len(np.union1d(x, y)):
                continue
            p = r.dirichlet([1, 1, 1]) if r.random() < 0.7 else [0.05, 0.05, 0.9]
            kinds = {t: int(r.choice([1, 2, 3], p=p)) for t in np.union1d(x, y).view(np.int64).tolist()}
            assert meet(x, y, kinds, percent)


@pytest.mark.parametrize("own", [12, 4])
def test_templates_stay_linear(spark, none, monkeypatch, own):
    """Pages of one template with words of their own that don't link: no combination makes them meet, however many they are."""
    monkeypatch.setattr(jaccard, "HOT", 100)
    template = [f"t{i}" for i in range(60)]
    met = []
    for n in (600, 1200):
        rows = [(i, " ".join(template[:30] + [f"u{i}x{k}" for k in range(own)] + template[30:]), None, None, None, None) for i in range(n)]
        join = jaccard.Join(spark.createDataFrame(rows, none.schema), 3, 90)
        assert join.classes.count() == 0 and join.pairs().count() == 0
        met.append((join._met(join.multi).count(), join.multi.groupBy("sig").agg(F.count_if(2 * F.col("r") <= join._most("n")).alias("m")).agg(F.max("m")).first()[0] or 0))
    assert met[1][0] <= 2 * met[0][0] + 10 and met[1][1] <= max(jaccard.HOT, jaccard.VERY)


def test_words_do_not_collide_by_construction():
    """Thue-Morse words and their complements collide under any polynomial modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    both = jaccard.word_hashes(word + " " + word.translate(str.maketrans("ab", "ba")) + " " + "a" * 200 + " " + "a" * 201 + " A")
    assert len(set(both.tolist())) == 5
    assert jaccard.word_hashes(" Ab " + "x" * 90 + "\n")[1] == jaccard.word_hashes("X" * 90)[0]


def test_distinct_documents(spark, docs):
    got = jaccard.distinct_documents(docs, 5, 80)
    assert got.columns == docs.columns
    roots = set()
    brute_classes(rows_of(), 5, 80, roots)
    assert got.count() == len(roots)


# ---------------------------------------------------------------- 3 language


def test_language(spark, none):
    r = np.random.default_rng(3)
    vocab = {"en": ["the", "of", "with", "thing", "whole"], "fr": ["été", "les", "que", "aux", "où"], "de": ["über", "und", "schön", "nicht", "zu"]}
    rows = []
    for i in range(300):
        lang = list(vocab)[i % 3]
        rows.append((i, " ".join(r.choice(vocab[lang], 12)), lang, None, None, None))
    rows += [(900, None, "en", None, None, None), (901, "12 !", "en", None, None, None), (902, "the of with", None, None, None, None), (None, "les que", "fr", None, None, None), (903, "the " * 300_000, "en", None, None, None)]
    got = langid.identify(spark.createDataFrame(rows, none.schema)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 300]
    assert len(held) > 40 and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
    assert np.mean([x.lang_pred == list(vocab)[x.doc_id % 3] for x in held]) > 0.95
    assert (by[900].lang_pred, by[900].score) == (by[901].lang_pred, by[901].score) == ("und", 0.0)
    assert by[902].lang_pred == by[903].lang_pred == "en" and by[None].held_out is None
    assert all(0 <= x.score <= 1 for x in got)
    assert langid.identify(none).count() == 0
    assert {x.lang_pred for x in langid.identify(spark.createDataFrame([(1, "abc", None, None, None, None)], none.schema)).collect()} == {"und"}


def test_grams_of_pieces(monkeypatch):
    text = "Ab cÉ-d  e1f ghi   jkl mno" * 9
    whole = langid.gram_counts(text)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PIECE", size)
        assert all((a == b).all() for a, b in zip(whole, langid.gram_counts(text), strict=True))


# ---------------------------------------------------------------- 4 shards


def test_shards(spark, docs, none):
    for n, size in ((24, 16 << 20), (5, 2000)):
        got = shuffle.shard(docs, n, bucket_bytes=size).select("row.*", "shard", "slot").collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter(rows_of())
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values()) if len(slots) == n else [0]) <= 1
    digest = {(r.doc_id, r.size, r.text_crc32) for r in shuffle.shard_digest(docs).collect()}
    assert digest == {(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows_of()}
    assert shuffle.shard_digest(none).count() == 0


def test_shards_in_two_turns(spark, docs, monkeypatch):
    monkeypatch.setattr(shuffle, "FAN", 3)
    one = sorted((tuple(r) for r in shuffle.shard(docs, 5, bucket_bytes=2000).select("row.doc_id", "row.text", "shard", "slot").collect()), key=str)
    monkeypatch.undo()
    assert one == sorted((tuple(r) for r in shuffle.shard(docs, 5, bucket_bytes=2000).select("row.doc_id", "row.text", "shard", "slot").collect()), key=str)


def test_running_sums(spark):
    r = np.random.default_rng(3)
    rows = [(s, k, int(r.integers(0, 9))) for s in (0, 1, 5) for k in range(int(r.integers(1, 40)))]
    df = spark.createDataFrame(rows, "s int, k int, v long")
    got = {(x.s, x.k): x.o for x in common.running_sums(df, ["s"], "k", "v", "o", 4).collect()}
    assert got == {(s, k): sum(v for t, j, v in rows if t == s and j < k) for s, k, _ in rows}
    one = df.where("s = 0").drop("s")
    assert [x.o for x in common.running_sums(one, [], "k", "v", "o", 3).orderBy("k").collect()] == [sum(v for t, j, v in rows if t == 0 and j < k) for s, k, _ in rows if s == 0]


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(shuffle.fisher_yates(4, np.random.default_rng(k))) for k in range(4800))
    assert len(seen) == 24 and max(seen.values()) < 290 and min(seen.values()) > 130


# ---------------------------------------------------------------- 5 mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_mixture(spark, docs, none):
    mix = mixing.Mix(docs, bucket_rows=10)
    got = [tuple(r) for r in mix.taken().collect()]
    sizes = Counter()
    for r in rows_of():
        sizes[r[3]] += len(re.findall(WS, r[1] or ""))
    assert len(got) == len(rows_of()) and sum(r[1] for r in got) == sum(sizes.values())
    assert all(0 <= r[4] <= 3 * r[1] for r in got)
    taken = Counter()
    for r in got:
        taken[r[2], r[3]] += r[4]
    for (_, target), words in taken.items():
        assert abs(words - target) <= 1
    pieces = mix.pieces().collect()
    assert sum(p.words for p in pieces) == sum(mix.words)
    slots = sorted({p.slot for p in pieces})
    assert len(slots) == len({(p.s, p.block) for p in pieces})
    assert sorted(got, key=key) == sorted((tuple(r) for r in mixing.Mix(docs, bucket_rows=10).taken().collect()), key=key)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() > 0
    assert max(Counter(r.doc_id for r in whole.collect() if r.doc_id not in (5, 6, None)).values()) <= 3
    assert mixing.Mix(none).taken().count() == 0 and mixing.mixed_documents(none).count() == 0


# ---------------------------------------------------------------- 6 personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark, docs, none):
    r = np.random.default_rng(8)
    bits = ["a@b.com", "%x@y-z.co.uk", "😀", "é", " ", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "0000000000000000001.2.3.4", "@", ".", "-", "\n", "+", "55", "word", "a@b", "+12345678901234567890"]
    texts = ["".join(r.choice(bits, int(r.integers(1, 14)))) for _ in range(300)]
    texts += ["7" * 20_000, "a" * 20_000 + "@b.c", "+" + "1 " * 5_000, "1.2.3.4 " * 700, "😀" * 100 + "q@w.ee", None, ""]
    rows = [(i, t, None, None, None, None) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in pii.detect(spark.createDataFrame(rows, none.schema)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:200]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k + ":") for s in want) for k in RULES]
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("id:")] == want
    assert pii.detect(docs).count() == len(rows_of()) and pii.detect(none).count() == 0


def brute_ids(rows, support=3, trust=0.8, accept=0.8):
    """The bootstrap in plain loops: (row number, start, end) of spans that only context tells."""
    places, total, seeds = [], Counter(), set()
    for at, r in enumerate(rows):
        text = r[1] or ""
        glued = re.sub(r"(?<=[0-9)])\x20(?=[0-9(])", pii.GLUE, text)
        for span in brute_spans(text):
            _, a, b = span.split(":")
            seeds.add(text[int(a) : int(b)].lower().replace(" ", pii.GLUE))
        found = list(re.finditer(WS, glued))
        w = ["", "", *[m[0] for m in found], ""]
        for k, m in enumerate(found):
            x, p2, p1, n1 = m[0], *(v.lower() for v in (w[k], w[k + 1], w[k + 3]))
            o, c = (x[0] if x[0] in pii.OPENING else ""), (x[-1] if x[-1] in pii.CLOSING else "")
            hs = [("l2", p2, p1, o), ("l", p1, o), ("r", c, n1), ("b", p1, o, c, n1)]
            total.update(hs)
            clean = x.lstrip(pii.OPENING).rstrip(pii.CLOSING)
            if re.search("[0-9@]", x) and len(clean) >= 5:
                a = m.start() + len(x) - len(x.lstrip(pii.OPENING))
                places.append((at, a, a + len(clean), clean, hs))
    n, shaped, score = defaultdict(Counter), {}, {}
    for *_, clean, hs in places:
        key = clean.lower()
        shaped[key] = shaped.get(key) or bool(re.fullmatch(pii.SHAPE, clean))
        score[key] = 1.0 if key in seeds or re.fullmatch(pii.DIGEST, key) else 0.0
        for h in hs:
            n[h][key] += 1
    while True:
        conf = {}
        for h, each in n.items():
            c = sum(k * score[i] for i, k in each.items()) / total[h]
            if sum(score[i] > 0 for i in each) >= support and c >= trust:
                conf[h] = c
        new = {}
        for i in score:
            mine = [conf[h] for h in conf if i in n[h]]
            if not score[i] and shaped[i] and mine and (s := 1 - math.prod(1.0000001 - c for c in mine)) >= accept:
                new[i] = s
        if not new:
            break
        score |= new
    own = [[tuple(map(int, s.split(":")[1:])) for s in brute_spans(r[1])] for r in rows]
    return {(at, a, b) for at, a, b, clean, hs in places if score[clean.lower()] > 0 and any(h in conf for h in hs) and not any(x < b and a < y for x, y in own[at])}


def check_ids(spark, none, rows):
    got = pii.detect(spark.createDataFrame([(i, r[1], None, None, None, None) for i, r in enumerate(rows)], none.schema).repartition(3)).collect()
    assert len(got) == len(rows)
    mine = {(x.doc_id, *map(int, s.split(":")[1:])) for x in got for s in x.spans.split(",") if s.startswith("id:")}
    assert mine == brute_ids(rows)
    assert all(x.n_spans == len([s for s in x.spans.split(",") if s]) and x.n_id == x.spans.count("id:") for x in got)
    return {(rows[at][1] or "")[a:b] for at, a, b in mine}


def test_pii_bootstrap(spark, none):
    rows = [(i, f"Some words here. Reach them: Member contact user{i}@mail.example.com and more text follows it") for i in range(20)]
    rows += [(50, "é before it: member contact AB-99812/7, then"), (51, "no pattern AB-99812/8 here"), (50, "é before it: member contact AB-99812/7, then")]
    rows += [(60 + i, "member of 42X-17 and " * 3) for i in range(5)]
    assert check_ids(spark, none, rows) == {"AB-99812/7"}


def test_pii_second_round_and_secrets(spark, none):
    """Digests seed a context; what it reaches induces another context, which reaches what no seed stands near."""
    rows = [(i, f'x{i} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" y{i}') for i in range(60)]
    rows += [(i, f"z token = \"K{i}-77{i}-AB\" q") for i in range(8)] + [(i, f"badge number K{i}-77{i}-AB, of late") for i in range(8)]
    rows += [(99, "badge number ZZ-1234 of late"), (98, "Token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"!! and"), (97, "in year 12345 we had 12345"), (96, None), (95, "")]
    told = check_ids(spark, none, rows)
    assert {"ZZ-1234", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "K1-771-AB"} <= told and "12345" not in told


def test_pii_bootstrap_at_random(spark, none):
    r = np.random.default_rng(9)
    bits = ["call", "me", "at", "the", '"', "a@b.com", "u@v.org", "c@d.net", "1.2.3.4", "9.8.7.6", "+1 (555) 123-4567", "AB-12345", "CD-67890,", '"EF-1111"', "(x9y8z7)", "id:", "4111 1111 1111 1111", "é"]
    for _ in range(3):
        rows = [(i, " ".join(r.choice(bits, int(r.integers(1, 12)))) if i % 9 else "call me " + str(r.choice(bits[5:15]))) for i in range(70)]
        check_ids(spark, none, rows)


def test_pii_support_is_absolute(spark, none):
    """A hot text with thousands of finds takes no pattern of five values away."""
    rows = [(i, f"Member contact user{i}@mail.example.com", None, None, None, None) for i in range(5)]
    rows += [(10, "member contact AB-99812/7", None, None, None, None), (11, "sent from q@w.ee " * 6000, None, None, None, None)]
    got = {x.doc_id: x.spans for x in pii.detect(spark.createDataFrame(rows, none.schema)).collect()}
    assert got[10] == "id:15:25"


# ---------------------------------------------------------------- 7 WARC


def test_warc(spark):
    big, small = "<p>é</p>" * 40, "tiny"
    rows = [(i, f"http://x/{i}", f"<html>{i}</html>" + "z" * (i * 3), 1) for i in range(60)]
    rows += [(500 + i, None, big, 1) for i in range(30)] + [(600 + i, "u\r\nv", small, 1) for i in range(3)] + [(700, "u", None, 1), (701, "u", "", 1), (None, "u", big, 2), (None, None, "q" * 200, 2), (None, None, "q" * 200, 2), (3, "again", rows[3][2], 1), (800, "u", "WARC/1.1\r\n\r\n" * 40_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file int").repartition(4)
    written = warc.write_monolithic(pages)
    manifest = warc.normalise(written).cache()
    got = sorted((tuple(r) for r in warc.read_back(manifest).collect()), key=key)
    least = {}
    for p, _, h, _ in rows:
        if p is not None and len((h or "").encode()) >= 100:
            least[h] = min(p, least.get(h, p))
    want = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        first = least.get(h)
        again = first is not None and p != first
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=key)
    import gzip

    ids, names = [], set()
    for r in manifest.collect():
        fs, path = warc.open_fs(r.path)
        with open(path, "rb") as f:
            heads = [h for h, _ in warc.records(f)]
        ids += [h["warc-record-id"] for h in heads]
        names |= {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"}
        with open(path, "rb") as f:
            raw = f.read()
        places = warc.index_entries(open(path + ".idx", "rb").read())
        assert len(places) == r.records and sum(n for _, n in places) == len(raw)
        assert all(gzip.decompress(raw[a : a + n]).startswith(b"WARC/1.1\r\n") for a, n in places)
        with open(path, "rb") as f:
            assert len(list(warc.records(f))) == r.records
    assert len(set(ids)) == len(ids) == len(rows) and names <= set(ids)
    assert warc.archive(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 8 top-k


def brute_top(rows, k=10):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, q in good:
        if i % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i))[:k]  # noqa: B905
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(scores))
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0, 4.0])
def test_top_k(spark, spread):
    r = np.random.default_rng(int(spread) + 1)
    centres = r.normal(size=(4, 12))
    rows = [(i, (centres[i % 4] * np.exp(spread * r.normal()) + 0.3 * r.normal(size=12)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[100][1]) for i in range(50)] + [(3000, None), (3001, [float("nan")] * 12), (3002, [None] * 12), (None, [1.0] * 12), (3100, []), (3101, [1.0, 2.0]), (200, [0.5] * 12), (3200, [0.0] * 12), (3300, [-float(x) for x in rows[5][1]])]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "vec_id long, embedding array<float>, block int, hi string").repartition(3)
    for size in (2048, 64):
        got = Counter(tuple(x) for x in topk.top_k(df, bucket=size, query_block=8).collect())
        assert got == brute_top(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_huge_numbers(spark):
    rows = [(100 * i, [1e15 * (i - 3), 3.0]) for i in range(8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 300").collect()
    assert [r.vec_id for r in got] == [0, 100, 200, 400, 500, 600, 700]


# ---------------------------------------------------------------- 9 lines


def brute_lines(rows):
    blank = " \t\n\x0b\x0c\r"
    ids = [r[0] if r[0] is not None else math.inf for r in rows]
    held = defaultdict(set)
    for i, r in zip(ids, rows, strict=True):
        for line in (r[1] or "").split("\n"):
            held[low(line.strip(blank))].add(i)
    out = []
    for i, r in zip(ids, rows, strict=True):
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(k := low(x.strip(blank))) >= 10 and len(held[k]) > 1 and i != min(held[k]))]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=key)


def test_lines(spark, docs, none):
    r = np.random.default_rng(4)
    pool = [" ".join(f"w{x}" for x in r.integers(0, 50, 6)) for _ in range(40)] + ["short", "", "  PADDED key Text ", "padded KEY text", "É" * 10, "é" * 10]
    rows = [(int(i), "\n".join(r.choice(pool, int(r.integers(1, 200)))), None, None, None, None) for i in range(60)] + rows_of()
    df = spark.createDataFrame(rows, none.schema).repartition(3)
    want = brute_lines(rows)
    assert sorted((tuple(x) for x in linededup.dedup_digest(df).collect()), key=key) == want
    maps = linededup.keep_bitmaps(df, rows_each=500, hot=50)  # the path of hot lines, and several ranges
    plain = linededup.keep_bitmaps(df)
    order = lambda m: sorted((x.d, x.tx, sorted(x.keep.items())) for x in m.collect())
    assert order(maps) == order(plain)
    assert linededup.dedup_digest(none).count() == 0


# ---------------------------------------------------------------- 10 tiling


def brute_tiles(doc, item, least):
    """Greedy string tiling as defined: all longest unmarked matches in order of place, until they are short."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n >= least and (not best or n > best[0][2]):
                    best = [(i, j, n)]
                elif best and n == best[0][2]:
                    best.append((i, j, n))
        if not best:
            return tiles
        for i, j, n in best:
            if all(free_d[i : i + n]) and all(free_i[j : j + n]):
                tiles.append((i, j, n))
                free_d[i : i + n] = free_i[j : j + n] = [False] * n


def test_tiles():
    r = np.random.default_rng(6)
    for _ in range(150):
        doc, item = r.integers(0, 4, int(r.integers(0, 40))).astype(np.uint64), r.integers(0, 4, int(r.integers(0, 25))).astype(np.uint64)
        assert sum(n for *_, n in decontaminate.tile(doc, item, 3)) == sum(n for *_, n in brute_tiles(doc.tolist(), item.tolist(), 3))


def brute_leaks(rows, items, least=5, share=0.5):
    cut = lambda t: decontaminate.WORD.findall(t.lower()) if t else []
    out = []
    for d, text, *_ in rows:
        for item_id, own, *_ in items:
            w = cut(own)
            if item_id is None or not w:
                continue
            tiles = brute_tiles(cut(text), w, min(least, len(w)))
            covered = sum(n for *_, n in tiles)
            if covered >= share * len(w):
                out.append((d, item_id, covered / len(w), len(tiles), covered, len(w)))
    return sorted(out, key=key)


def test_leaks(spark, docs, none, monkeypatch):
    item = " ".join(f"b{x}" for x in range(30))
    w = item.split()
    rows = [(1, "before it " + item.upper() + ", after"), (2, " ".join(w[20:] + ["x"] + w[:10] + ["y"] + w[10:20])), (3, " ".join(w[:12])), (4, " ".join(w[:4] + ["x"] + w[5:9])), (None, item), (5, "it says one two, and 我们在这里吃饭 today"), (6, None), (7, ""), (1, "before it " + item.upper() + ", after")]
    rows = [(*r, None, None, None, None) for r in rows]
    bench = [(7, item, 1), (8, "one two", 1), (9, None, 1), (None, item, 1), (10, "q " * 40, 1), (11, "我们在这里吃饭吗", 1), (12, "two one", 1), (13, "", 1), (7, item, 2), (14, item + " and more of it", 3)]
    df, items = spark.createDataFrame(rows, none.schema), spark.createDataFrame(bench, "item_id long, text string, doc_id int")
    want = brute_leaks(rows, bench)
    assert {(1, 7), (2, 7), (None, 7), (5, 8), (5, 11)} <= {x[:2] for x in want} and (5, 12) not in {x[:2] for x in want}
    for bits, fits in ((1 << 16, 1 << 19), (64, 0)):  # a filter full of false hits, and seeds and texts that meet in a shuffle
        monkeypatch.setattr(decontaminate, "LEAST_BITS", bits)
        monkeypatch.setattr(decontaminate, "MOST_BITS", max(bits, 64))
        monkeypatch.setattr(decontaminate, "FITS", fits)
        assert sorted((tuple(x) for x in decontaminate.leaks(df, items).collect()), key=key) == want
    both = df.unionByName(docs)
    left = decontaminate.clean(both, items)
    gone = {(x[0]) for x in want}
    assert left.columns == both.columns and left.count() == both.count() - sum(r[0] in gone for r in rows) - sum(r[0] in gone and False for r in rows_of())
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0


def test_leaks_at_random(spark, none):
    r = np.random.default_rng(12)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 6, n))
    items = [(i, text(int(r.integers(1, 20))), 0) for i in range(12)]
    rows = [(i, text(int(r.integers(0, 60))) + " " + str(items[i % 12][1]) * int(r.integers(0, 2)), None, None, None, None) for i in range(40)]
    got = decontaminate.leaks(spark.createDataFrame(rows, none.schema), spark.createDataFrame(items, "item_id long, text string, doc_id int")).collect()
    assert sorted(map(tuple, got), key=key) == brute_leaks(rows, items)

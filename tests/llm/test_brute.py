"""Each query of the subpackage against a brute-force version on the smallest tables, a round trip, or held-out accuracy."""

import hashlib
import itertools
import math
import re
import time
from collections import Counter, defaultdict
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from leafmill.llm import html_text, line_dedup, mixing, near_texts, pieces, quality, repeats, simhash_docs, weighted_prints
from leafmill.llm.sharding import longest_first

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name, folder=FOLDER):
    return entry.queries()[name](spark, folder).collect()


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def votes(hashes):
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def lines_gone(texts):
    """Numbers of the lines that go, for each document: of each connected group all but the first, by all pairs of lines."""
    seen, prints, codes, order = {}, {}, {}, []
    for d, t in sorted(texts.items()):
        for i, line in enumerate(t.split("\n")):
            words = [w for w in regex.split(r"[^\p{L}\p{N}]+", re.sub("[0-9]", "0", line.lower())) if w]
            if words:
                n = " ".join(words)
                order.append((d, i, n))
                if n not in seen:
                    seen[n] = (d, i)
                    prints[n], codes[n] = votes([xxhash.xxh64_intdigest(w, 42) for w in words]), words
    names, sets = list(seen), Sets()
    for i, a in enumerate(names):
        for b in names[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and distance(codes[a], codes[b]) <= int(max(len(codes[a]), len(codes[b])) * 0.2 + 1e-9):
                sets.join(a, b)
    kept, gone = {}, defaultdict(list)
    for d, i, n in order:
        if kept.setdefault(sets.find(n), (d, i)) != (d, i):
            gone[d].append(i)
    return gone


def without(text, gone):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in set(gone))


def first_of_near(texts):
    """The least document of each group of those whose sets of five-word shingles are alike at 0.8, by all pairs."""
    sets, shingles = Sets(), {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        shingles[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for a in sorted(texts):
        sets.find(a)
        for b in texts:
            if b < a and (shingles[a] == shingles[b] or len(shingles[a] & shingles[b]) >= 0.8 * max(1, len(shingles[a] | shingles[b]))):
                sets.join(a, b)
    return {sets.find(d) for d in texts}


@pytest.mark.parametrize("together", [4096, 3])
def test_lines(spark, texts, monkeypatch, together):
    """together: lines of one key that are compared at once; larger keys are cut."""
    monkeypatch.setattr(line_dedup, "TOGETHER", together)
    gone = lines_gone(texts)
    for r in rows(spark, "op1_line_dedup"):
        assert r.removed_lines == gone[r.doc_id] and r.kept_sha256 == hashlib.sha256(without(texts[r.doc_id], gone[r.doc_id]).encode()).hexdigest()


def test_pipeline(spark, tmp_path):
    """Each stage of the pipeline against a plain version, on what the stage before it wrote."""
    at = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, FOLDER).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        found[name] = at.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    docs = {r.doc_id: r.text for r in found["quality"]}
    known = [d for d in labels if labels[d] == 1]
    assert sum(d in docs for d in known) >= 0.95 * len(known) and sum(labels.get(d) == 0 for d in docs) <= 0.1 * sum(q == 0 for q in labels.values())
    gone = lines_gone(docs)
    docs = {d: without(t, gone[d]) for d, t in docs.items()}
    assert {r.doc_id: r.text for r in found["line_dedup"]} == docs and all(r.n_chars == len(r.text) for r in found["line_dedup"])
    left = {d: docs[d] for d in first_of_near(docs)}
    assert {r.doc_id: r.text for r in found["simhash_near_dedup"]} == left
    copies = Counter(r.doc_id for r in found["mixing"])
    assert set(copies) <= set(left) and set(copies.values()) <= {1, 2} and all(r.text == left[r.doc_id] for r in found["mixing"])
    source = {r.doc_id: r.source for r in found["simhash_near_dedup"]}
    target = {r.doc_id: r.target for r in mixing.mix(spark.read.parquet(f"{tmp_path}/simhash_near_dedup")).collect()}
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in left.items()}
    for s in set(source.values()):
        own = [d for d in left if source[d] == s]
        total, sums = sum(words[d] for d in own), {0}
        whole = min(int(target[own[0]] // total), 2) if total else 0
        for d in own:
            sums |= {x + words[d] for x in sums}
        rest = round(target[own[0]]) - whole * total
        assert sum(copies[d] * words[d] for d in own) == whole * total + max(x for x in sums if x <= max(rest, 0))
    assert Counter((r.doc_id, r.decoded_sha256) for r in found["sentencepiece"]) == Counter({(d, hashlib.sha256(left[d].encode()).hexdigest()): n for d, n in copies.items()})


def test_pieces_round_trip(spark, texts):
    for r in rows(spark, "op2_sentencepiece"):
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_pieces


def test_pieces_distribution():
    p = pieces.Pieces(pieces.read_model())
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {model.id_to_piece(i): i for i in range(model.get_piece_size())}
    ways = {}

    def walk(rest, ids, weight):
        if not rest:
            ways[tuple(ids)] = math.exp(weight)
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                walk(rest[n:], [*ids, known[rest[:n]]], weight + p.weight[known[rest[:n]]])

    walk("▁thenea", [], 0.0)
    n = 20_000
    ids, counts = p.sample(["thenea"] * n, np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64))
    ends = np.cumsum(counts)
    got = Counter(tuple(ids[e - c : e].tolist()) for c, e in zip(counts, ends, strict=True))
    assert set(got) <= set(ways)
    assert max(abs(got[k] / n - w / sum(ways.values())) for k, w in ways.items()) < 0.02
    odd = ["", "a", "  a", "a ", "a  b   c ", " ", "\n\n x", "▁", "a▁b ▁ c", "日本語 😀 \x00 é", "x" * 5000, "tab\tq  "]
    ids, counts = p.sample(odd, np.arange(len(odd), dtype=np.uint64))
    assert [b.decode() for b in p.decode(ids, counts)] == odd
    again, _ = p.sample(odd[9:10], np.arange(9, 10, dtype=np.uint64))
    at = counts[:9].sum()
    assert (again == ids[at : at + len(again)]).all()


def sampled(p, known, text, seed):
    """One text's ids, a unit after the other: all ways forward, then back from the end by the same draws."""
    out = []
    for u, unit in enumerate(pieces.units(text)):
        chars = ["▁"] + ["\U0010ffff" if c == "▁" else "▁" if c == " " else c for c in unit]
        n, ways, edges = len(chars), [1.0] + [0.0] * len(chars), {}
        for end in range(1, n + 1):
            found = [(end - k, known["".join(chars[end - k : end])]) for k in range(1, min(end, 40) + 1) if "".join(chars[end - k : end]) in known]
            if not any(s == end - 1 for s, _ in found):
                found.append((end - 1, p.size))
            w = [p.share[i] * pieces._POWERS[end - s] for s, i in found]
            for (s, _), x in zip(found, w, strict=True):
                ways[end] += ways[s] * x
            part = list(itertools.accumulate(ways[s] * x / ways[end] for (s, _), x in zip(found, w, strict=True)))
            edges[end] = found, [round(x * 2**24) for x in part[:-1]] + [2**24]
        ids, at, step = [], n, 0
        while at:
            r = int(pieces._uniform(np.array([seed]), np.array([u]), step)[0])
            found, bounds = edges[at]
            k = next(k for k, b in enumerate(bounds) if b > r)
            ids.append([found[k][1]] if found[k][1] < p.size else [p.first_byte + b for b in ("▁" if chars[at - 1] == "\U0010ffff" else chars[at - 1]).encode()])
            at, step = found[k][0], step + 1
        out += [i for x in reversed(ids) for i in x]
    return out


def test_pieces_brute(spark, texts):
    """Ids of the whole query against a second, plain implementation."""
    p = pieces.Pieces(pieces.read_model())
    known = {p.bytes[i].decode().replace(" ", "▁"): i for i in range(p.size) if p.bytes[i] and not p.first_byte <= i < p.first_byte + 256}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seeds = {r.doc_id: r.key for r in docs.select("doc_id", F.xxhash64(F.lit(0), F.col("doc_id").cast("long"), F.col("doc_id").isNull()).alias("key")).collect()}
    for r in rows(spark, "op2_sentencepiece"):
        if max(map(len, pieces.units(texts[r.doc_id])), default=0) < pieces.LONG:
            assert r.ids == sampled(p, known, texts[r.doc_id], np.int64(seeds[r.doc_id]).view(np.uint64))


def test_pieces_alone(texts, monkeypatch):
    """A text's ids do not depend on what is segmented with it, before it, or kept of it."""
    some = [t for _, t in sorted(texts.items())][:60]
    seeds = np.random.default_rng(2).integers(0, 2**63, len(some)).astype(np.uint64)
    p = pieces.Pieces(pieces.read_model())
    ids, counts = p.sample(some, seeds)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    monkeypatch.setattr(pieces, "KEPT", 1000)
    q = pieces.Pieces(pieces.read_model())
    for k in reversed(range(len(some))):
        assert (q.sample(some[k : k + 1], seeds[k : k + 1])[0] == parts[k]).all()
        assert (p.sample(some[k : k + 1], seeds[k : k + 1])[0] == parts[k]).all()


def test_neighbours(spark):
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    got = defaultdict(list)
    for r in rows(spark, "op3_nearest_neighbours"):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    recall = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - v[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(math.isclose(s, d[np.searchsorted(ids, i)], abs_tol=1e-12) for _, i, s in found)
        recall.append(np.isin(best, [i for _, i, _ in found]).mean())
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, texts, monkeypatch, hot):
    """hot: with every shard counted by hash."""
    if hot:
        monkeypatch.setattr(repeats, "HOT", 0)
    data = {d: t.encode() for d, t in texts.items()}
    count = Counter(b[i : i + 400] for b in data.values() for i in range(len(b) - 399))
    for r in rows(spark, "op4_suffix_array_dedup"):
        b = data[r.doc_id]
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        assert r.n_kept == len(kept) and r.n_chars == len(r.text) and (r.text == texts[r.doc_id]) == (not any(gone)) and r.text == kept.decode(errors="replace")


def test_repeats_keep_first(spark):
    a, b = "".join(f"{i:04d}" for i in range(60)), "".join(f"{i:04d}" for i in range(500, 560))
    docs = spark.createDataFrame([(1, a), (2, "x" + a + b), (3, b + a[:100])], "doc_id long, text string")
    out = {r.doc_id: bytes(r.kept).decode() for r in repeats.remove_repeats(docs, 64, "first").collect()}
    assert out == {1: a, 2: "x" + b, 3: ""}


def test_mixing(spark, texts):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    budget, stopped = 1.5 * sum(total.values()), set()
    while True:
        free = [s for s in total if s not in stopped]
        left = budget - sum(2 * total[s] for s in stopped)
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * total[s]}
        if not over:
            break
        stopped |= over
    target |= {s: 2.0 * total[s] for s in stopped}
    taken = Counter()
    got = rows(spark, "op5_mixing")
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and math.isclose(r.target, target[source[r.doc_id]]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] += r.taken
    for s in total:  # no subset of the source's documents comes nearer from below
        whole = int(target[s] // total[s])
        sums = {0}
        for d, n in size.items():
            if source[d] == s:
                sums |= {x + n for x in sums}
        assert taken[s] == whole * total[s] + max(x for x in sums if x <= round(target[s]) - whole * total[s])
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in rows(spark, "op5_mixing")}


def test_sharding(spark, texts):
    got, load, slots, groups = rows(spark, "op6_sharding"), Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[texts[r.doc_id]].add(r.shard)
        assert r.law == "bytes" and r["size"] == len(texts[r.doc_id].encode()) + 8
    assert all(len(s) == 1 for s in groups.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for t in texts.values():
        sizes[t] += len(t.encode()) + 8
    want = Counter()
    order = sorted(sizes.values(), reverse=True)
    for n, k in zip(order, longest_first(order, [0.0] * 24), strict=True):
        want[k] += n
    assert max(load.values()) <= max(want.values()) * 1.01


def test_html(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in rows(spark, "op7_html_extraction"):
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", article.replace("<br>", " "))]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("tail", ['"a" ', "'a' ", '"', '="', "<a ", "<a x=\"'", "</script ", "<b>", "<div>", "='x' "])
def test_html_malformed(tail):
    """A tag that nothing closes takes no more than linear time, and the text before it stays."""
    for n in (20, 10_000):
        began = time.time()
        assert html_text.Page("<p>text</p><a " + tail * n).text() == "text" and time.time() - began < 5
    assert html_text.Page("<p title=\"a > b\" class='x'>one</p><p data-x=it's>two</p>" + "<p>three" * 20_000).text().startswith("one\n\ntwo\n\nthree")


def test_html_names():
    """Names of what stands beside an article leave out no text within it; adverts and comments go wherever they stand."""
    body = "".join(f"<p>This is paragraph {k} of the text, long enough to be what the page is about, and without links.</p>" for k in range(5))
    page = f"<body><nav><a href='/'>Home</a></nav><article><h1>Title</h1>{body}<div class='search results'><p>A search that found much.</p></div><p class='legal'>A legal word.</p><ul class='tags'><li>one</ul><div class='ad'>Buy!</div><div id='comments'><p>I like it.</p></div></article><div class='notice'>We care.</div>"
    text = html_text.Page(page).text()
    assert text.startswith("Title\n\nThis is paragraph 0") and text.endswith("A search that found much.\n\nA legal word.\n\none")


class Tree(HTMLParser):
    """Elements as [tag, parent's number, own text]; pages here close every tag."""

    def __init__(self, page):
        super().__init__()
        self.nodes, self.at = [["html", None, ""]], [0]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.nodes.append([tag, self.at[-1], ""])
        self.at.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        self.at.pop()

    def handle_data(self, data):
        self.nodes[self.at[-1]][2] += data


def densest(page):
    """Texts of the paragraphs under the element whose children's densities sum to most, worked out for each element from all that is below it."""
    nodes = Tree(page).nodes

    def below(i):
        return [i] + [x for j, n in enumerate(nodes) if n[1] == i for x in below(j)]

    def count(i):
        under, links = below(i), set()
        for j in under:
            if nodes[j][0] == "a":
                links |= set(below(j))
        size = lambda js: sum(len(nodes[j][2].replace(" ", "")) for j in js)
        return size(under), len(under) - 1, size(links), len(links)

    c_all, _, lc_all, _ = count(0)
    density = []
    for i in range(len(nodes)):
        c, t, lc, lt = count(i)
        if not c:
            density.append(0)
            continue
        base = math.log(c / max(c - lc, 1) * lc + lc_all / c_all * c + math.e)
        density.append(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(base))
    sums = [sum(density[j] for j, n in enumerate(nodes) if n[1] == i) for i in range(len(nodes))]
    return [nodes[j][2] for j in below(sums.index(max(sums))) if nodes[j][0] == "p"]


def test_html_density():
    """Pages of nothing but div, ul, li, a and p, without names: what density alone finds, against a second tree."""
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("abcdefghij"[x] * 5 for x in rng.integers(0, 10, int(n)))
    for _ in range(60):
        links = lambda: "<ul>" + "".join(f"<li><a>{words(2)}</a></li>" for _ in range(int(rng.integers(4, 12)))) + "</ul>"
        text = "".join(f"<p>{words(rng.integers(20, 80))}</p>" for _ in range(int(rng.integers(3, 12))))
        page = f"<body><div>{links()}</div><div><div>{links()}<div><a>{words(3)}</a></div></div><div>{text}</div></div><div>{links()}</div></body>"
        assert html_text.Page(page).text().split("\n\n") == densest(page)


def test_simhash(spark, texts):
    prints, sets = {}, Sets()
    for d, t in texts.items():
        w = t.encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = votes([xxhash.xxh64_intdigest(s, 42) for s in shingles])
    for a in prints:
        for b in prints:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 3:
                sets.join(a, b)
    for r in rows(spark, "op8_simhash_near_dedup"):
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == sets.find(r.doc_id)


def test_simhash_cut_shards(spark):
    """A shard cut into blocks links what one tree links."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    values = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(n), replace=False)) for n in rng.integers(0, 6, 300)})
    fps = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    sets = []
    for tree in (2048, 7):
        s = Sets()
        for v in fps.collect():
            s.find(v.fp)
        for r in simhash_docs.near_links(fps, 3, tree).collect():
            assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3
            s.join(r.a, r.b)
        sets.append({v: s.find(v) for v in list(s)})
    s = Sets()
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                s.join(int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64)))
    want = {v: s.find(v) for v in sets[0]}
    assert sets[0] == sets[1] == want


def test_quality_marginals():
    """Forward-backward against all labellings of documents of up to seven lines, and the gradient's expected transitions."""
    rng = np.random.default_rng(6)
    k = quality.FEATURES
    model = quality.Model([np.sort(rng.random(4)) for _ in range(k)], *(rng.normal(size=(k, quality.BINS)) / 3 for _ in range(3)), rng.normal(size=2), rng.normal(size=(2, 2)), 0.3)
    counts = np.array([1, 4, 7, 2, 5])
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    first = np.zeros(counts.sum(), bool)
    first[starts] = True
    x = rng.random((counts.sum(), k))
    bins = model.bins(x)
    emissions = model.emissions(bins, first)
    good, pairs = quality.marginals(emissions, starts, counts, model)
    want, moves = np.zeros(len(x)), np.zeros(6)
    for s, n in zip(starts, counts, strict=True):
        weights, labellings = [], list(itertools.product((0, 1), repeat=int(n)))
        for y in labellings:
            w = model.start[y[0]]
            for t in range(n):
                own = model.bias + sum(model.own[f, bins[s + t, f]] for f in range(k))
                own += sum(model.before[f, bins[s + t - 1, f]] for f in range(k)) if t else 0
                own += sum(model.after[f, bins[s + t + 1, f]] for f in range(k)) if t < n - 1 else 0
                w += y[t] * own + (model.step[y[t - 1], y[t]] if t else 0)
            weights.append(math.exp(w))
        for y, w in zip(labellings, weights, strict=True):
            p = w / sum(weights)
            want[s : s + n] += p * np.array(y)
            moves[4 + y[0]] += p
            for a, b in itertools.pairwise(y):
                moves[2 * a + b] += p
    assert np.allclose(good, want) and np.allclose(pairs, moves)
    sizes = rng.integers(0, 90, len(x)).astype(float)
    assert np.allclose(quality.aggregate(good, sizes, starts), [np.average(want[s : s + n], weights=sizes[s : s + n] + 1) for s, n in zip(starts, counts, strict=True)])


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows(spark, "op9_quality", "/root/testdata/sf0.01") if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_prints_parts(spark, monkeypatch):
    """Rows of one doc_id, of null, and few bytes a part: the order of documents does not depend on how it is cut."""
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(0, 30))))
    rows = [(int(d), text()) for d in rng.integers(-50, 50, 150)] + [(7, text()) for _ in range(150)] + [(None, text()) for _ in range(100)] + [(7, "same"), (7, "same"), (-(2**63), "least"), (2**63 - 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = sorted(map(tuple, weighted_prints.prints(docs).collect()), key=str)
    monkeypatch.setattr(weighted_prints, "PART", 1500)
    assert len(whole) == len(rows) and sorted(map(tuple, weighted_prints.prints(docs).collect()), key=str) == whole
    assert weighted_prints.with_next(docs.select("doc_id", "text")).groupBy("part").count().agg({"count": "max"}).first()[0] < 100


def test_prints(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in rows(spark, "op10_fingerprints")}

    def alike(a, b):
        a, b = Counter(a.lower().split()), Counter(b.lower().split())
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    errors = []
    for i, d in enumerate(order):
        t, u, r = texts[d], texts[order[(i + 1) % len(order)]], got[d]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        errors += [r.near_edited - alike(t, e), r.near_next - alike(t, u)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


@pytest.mark.parametrize("tree", [256, 3])
def test_near_texts(spark, monkeypatch, tree):
    """The pipeline's stage against all pairs: copies with words changed, chains of them, and shards cut into blocks."""
    monkeypatch.setattr(near_texts, "TREE", tree)
    rng = np.random.default_rng(5)
    data, at = {}, 0
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 300)))]
        for _ in range(int(rng.integers(1, 9))):
            for k in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 60))):
                words[k] = f"w{rng.integers(0, 5000)}"
            data[at] = " ".join(words)
            at += 1
    sets = Sets()
    shingles = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in data.items()}
    for a in data:
        sets.find(a)
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                sets.join(a, b)
    docs = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_texts.keep_first(docs).collect()) == sorted({sets.find(d) for d in data})

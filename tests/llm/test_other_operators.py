"""Archives, vectors, decontamination, toxicity and the pipeline."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from bidflow.llm import decontam, embed_dedup, graph, toxicity, warc_arc
from bidflow.llm.common import new_folder
from tests.llm.data import edited, frame, prose

PAGES = [(5, "http://a/ b", "x"), (2, "http://b", "x"), (9, None, None), (3, "http://c", ""), (7, "http://d\nq", "Zürich\r\n\r\nWARC/1.1\r\n\r\n"), (2, "http://b", "x"), (None, "http://e", "x"), (8, "http://f", "y" * 5000), (None, None, None)]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_arc_round_trip(spark, size, monkeypatch):
    monkeypatch.setattr(warc_arc, "ARCHIVE_BYTES", size)
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, path string")
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    warc_arc.write_arc(pages, arc)
    warc_arc.convert(spark, arc, warc)
    got = [tuple(r)[:5] for r in warc_arc.read_warc(spark, warc, keep_payload=True).collect()]
    first = {}
    for page, _, html in PAGES:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    wanted, taken = [], set()
    for page, _, html in PAGES:
        revisit = page is not None and (page != first[html or ""] or page in taken)
        taken.add(page)
        wanted.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    assert Counter(got) == Counter(wanted)


def test_arc_versions_and_lengths():
    one = warc_arc.version_block(1, "n") + warc_arc.arc_record(1, 4, "http://a b/c", b"\nhttp://not 1 2 3 4\n", "n", 0)
    two = warc_arc.version_block(2, "n") + warc_arc.arc_record(2, None, "u", b"", "n", 0)
    ((fields, page, _, payload),) = warc_arc.pages_of(one)
    assert fields["URL"] == "http://a b/c" and page == 4 and payload == b"\nhttp://not 1 2 3 4\n"
    (other,) = warc_arc.pages_of(two)
    assert other[0]["Result-code"] == "200" and other[1] is None and other[3] == b""
    with pytest.raises(ValueError, match="declares"):
        [*warc_arc.parse_arc(one[:-1])]
    with pytest.raises(ValueError, match="header line"):
        [*warc_arc.parse_arc(b"nonsense\n")]


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    warc_arc.write_arc(pages, arc)
    warc_arc.convert(spark, arc, warc)
    assert warc_arc.read_warc(spark, warc).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and set(root) - set(got) <= {7} - set(range(41)) | {a for a, b in pairs if a == b}


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(32) for _ in range(300)]
    for size in (2, 5, 40):
        base = rng.standard_normal(32)
        out += [base + 0.12 * rng.standard_normal(32) for _ in range(size)]
    out += [out[3], out[3], out[3] * 2.5]
    rows = [(i * 2 + 1, x.tolist()) for i, x in enumerate(out)]
    return rows + [rows[9], (None, out[3].tolist()), (2, None), (4, []), (6, [0.0] * 32), (8, [1.0, None]), (10, [float("nan")] * 32), (12, [float("inf")] * 32), (14, [1.0, 0.0]), (16, [2.0, 0.0]), (18, [1e200, -1e200, 3e200]), (20, [1e-200, -1e-200, 3e-200]), (22, [0.1, -0.1, 0.3])]


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect() if r["vec_id"] is not None}
    able = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    able = [(i, v / np.abs(v).max()) for i, v in able]
    links, found = Counter(), Counter()
    for k, (i, x) in enumerate(able):
        for m, (j, y) in enumerate(able):
            if k != m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[i] += 1
    for i in {i for i, _ in able}:
        copies = sum(j == i for j, _ in able)
        found[i] = got[i]["n_links"] * copies
        assert got[i]["n_links"] * copies <= links[i]
    assert found.total() >= 0.9 * links.total()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (2, 4, 6, 8, 10, 12))
    assert [got[i]["n_links"] for i in (18, 20, 22)] == [2, 2, 2] and got[22]["component_id"] == 18
    assert got[14]["component_id"] == got[16]["component_id"] == 14 and not got[16]["kept"]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


QUESTION = "If Maria buys 12 apples and gives 5 apples to Tom then how many apples does Maria keep after the trip"


def test_decontamination(spark):
    rng = random.Random(2)
    docs = [
        (1, f"{prose(rng, 30)}. {QUESTION}. {prose(rng, 20)}"), (2, f"{prose(rng, 9)}. " + QUESTION.replace("Maria", "Anna").replace("12", "31").replace("Tom", "Bob")), (3, QUESTION.replace("Maria keep", "Tom keep").replace("buys 12", "buys 7")),
        (4, prose(rng, 200)), (5, None), (6, ""), (None, QUESTION), (7, "If Maria buys 12 apples"), (8, "short item text"), (1, "x"),
    ]
    bench = spark.createDataFrame([(10, QUESTION, 1), (11, None, 1), (12, "", 1), (13, "short item text", 1), (10, QUESTION, 1)], "item_id long, text string, doc_id int")
    got = decontam.contaminated(frame(spark, docs), bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter({(1, 10): 2, (2, 10): 2, (None, 10): 2, (8, 13): 1})
    assert {r["exact"] for r in got if r["doc_id"] == 2} == {False}
    kept = decontam.clean(frame(spark, docs), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7] and kept.columns == frame(spark, docs).columns
    assert decontam.contaminated(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontam.contaminated(frame(spark, docs).limit(0), bench).count() == 0


def items_found(spark, text, items, doc=1):
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    return sorted((r["item_id"], r["exact"]) for r in decontam.contaminated(frame(spark, [(doc, text)]), bench).collect())


def test_copies_in_any_case_are_contaminated(spark):
    german = "Wenn Maria im Garten zehn Äpfel pflückt und Tom in der Küche drei Kuchen mit Äpfeln backt wie viele Äpfel hat Maria"
    short = "Grab the red box near the door"
    items = [QUESTION, german, short]
    texts = [(10 * k + n, text) for k, item in enumerate(items) for n, text in enumerate((item, item.lower(), item.upper(), f"before it {item} after"))]
    texts += [(100, QUESTION.replace("Maria", "Anna").replace("Tom", "Bob")), (101, short.replace("red", "blue")), (102, QUESTION.replace("Maria keep", "Tom keep").lower())]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["exact"]) for r in decontam.contaminated(frame(spark, texts), bench).collect())
    assert got == sorted([(10 * k + n, k, True) for k in range(3) for n in range(4)] + [(100, 0, False)])


def test_slots(spark):
    shop = "James buys 5 kg of rice and 7 kg of flour. James pays twelve dollars for the rice. James has 30 dollars left after that"
    for other in (
        shop.replace("James", "Maria"),  # names that open sentences
        shop.replace("twelve", "nine").replace("5 kg", "6 kg"),
        shop.replace("7", "5").replace("30", "5"),  # values that become equal
        "A text. " + shop.replace("James pays", "James then pays"),
    ):
        assert items_found(spark, other, [shop]) == [(0, False)]
    assert items_found(spark, shop.replace("James pays", "Maria pays"), [shop]) == []
    assert items_found(spark, "the load of 5kg rests on the beam for 3min before it is moved away again", ["the load of 9kg rests on the beam for 8min before it is moved away again"]) == [(0, False)]
    again = "one two or more of the same " * 5
    assert items_found(spark, again, [again]) == [(0, True)]


def brute_items(docs, items, window=8, cover=0.6):
    """Pairs (doc, item) by comparing every document with every item, on the words themselves."""

    def canonical(text):
        out, opening = [], True
        for raw in (text or "").split():
            word = raw.strip(".,;:!?\"'()[]{}<>|*#&$%_-")
            low = word.casefold()
            if word:
                m = re.fullmatch(r"[$+-]?[0-9][0-9.,:/]*%?([a-z]*)", low)
                slot = "n" if low.encode() in decontam.NUMBER_WORDS or m and (not m[1] or m[1].encode() in decontam.UNITS) else "u" if low.encode() in decontam.UNITS and out and out[-1][0] == "n" else "p" if word[0].isupper() else ""
                out.append((slot, low, opening))
            opening = raw.endswith((".", "!", "?", ":", "|"))
        return out

    found = set()
    for d, text in docs:
        doc = canonical(text)
        for i, item_text in items:
            item = canonical(item_text)
            size = min(window, len(item))
            if not size:
                continue
            common = {w for s, w, _ in doc + item if not s}
            for form in "np":  # with names as slots, and as words
                of = lambda x, form=form: [s if s in ("n", "u") or s == "p" and form == "n" else w for s, w, _ in x]
                a, b = of(item), of(doc)
                total = len(a) - size + 1
                shifts = Counter(j - k for k in range(total) for j in range(len(b) - size + 1) if a[k : k + size] == b[j : j + size])

                def fits(shift, item=item, doc=doc, form=form):
                    to, back = {}, {}
                    for k, (s, w, o) in enumerate(item):
                        if s and 0 <= k + shift < len(doc):
                            t, x, p = doc[k + shift]
                            if (s == t or form == "p" and s == "p" and x in {w for s, w, _ in item if s == "p"}) and not (s == "p" and o and p and {w, x} & common):
                                if to.setdefault((s, w), x) != x or s == "p" and back.setdefault(x, w) != w:
                                    return False
                    return True

                for lead in shifts:
                    near = [s for s in shifts if 0 <= s - lead <= (len(item) // 2 if lead in shifts else 0)]
                    if any(shifts[s] >= cover * total and fits(s) for s in near) or sum(shifts[s] for s in near) >= cover * total and all(map(fits, near)):
                        found.add((d, i))
    return found


def test_decontamination_by_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    name = lambda: rng.choice("Anna Bob Carla Dirk Eva Finn".split())
    item = lambda: " ".join(rng.choice([name(), str(rng.randrange(99)), f"{rng.randrange(9)} kg", *(prose(rng, 1) for _ in range(4))]) for _ in range(rng.randrange(3, 40)))
    items = [(i, item()) for i in range(30)]
    docs = [(100 + n, f"{prose(rng, rng.randrange(30))}. {rng.choice([str, str.lower, str.upper])(edited(rng, items[n % 30][1], rng.randrange(4)))} {prose(rng, rng.randrange(30))}") for n in range(90)]
    docs += [(200 + n, items[n][1].replace("Anna", "Zoe").replace("Bob", "Yan").replace("7", "8")) for n in range(30)] + [(300 + n, prose(rng, 300)) for n in range(5)]
    docs += [(400, " ".join(t for _, t in items) * 3 + prose(rng, 5000))]
    monkeypatch.setattr(decontam, "KNOWN_WORDS", 50)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(spark, docs), bench).collect()}
    assert got == brute_items(docs, items) and len(got) > 60
    clash = frame(spark, docs).selectExpr("*", "1 as __gone_id", "2 as did", "3 as th")
    assert {r["doc_id"] for r in decontam.clean(clash, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def labelled(n=400, seed=8):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = prose(rng, 60) + (" " + " ".join(rng.choice(["vile", "filth", "crook"]) for _ in range(3)) if toxic else "")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return rows + [(None, "vile filth"), (n + 1, None), (n + 2, ""), (0, rows[0][1])], labels + [(n + 7, 1, 1), (3, 0, None), (None, 0, 1), (6, 0, 5)]


def test_toxicity(spark):
    rows, labels = labelled()
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    assert {"vile", "filth", "crook"} <= set(model.vocabulary)
    got = toxicity.score(docs, model)
    assert set(docs.columns) <= set(got.columns)
    truth = {i: y for i, _, y in labels[:400]}
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    odd = {r["doc_id"]: r["predicted"] for r in got.collect()}
    assert odd[None] == 1 and odd[401] == odd[402] == 0


def test_nearest_is_exact(spark):
    rows, labels = labelled()
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    vectors = np.zeros((len(model.count), len(model.idf)))
    for t, (docs, w, _) in enumerate(model.postings):
        vectors[docs, t] = w
    for v in ({0: 1}, {0: 2, 1: 1}, {t: 1 for t in range(len(model.idf))}):
        query = *toxicity.flat([np.array([*v.items()])]), 1
        terms, w = query[1], model.unit(*query)
        sims = vectors[:, terms] @ w
        order = np.argsort(-sims, kind="stable")
        order = order[sims[order] > 0]
        kth = sims[order[min(len(order) - 1, np.searchsorted(np.cumsum(model.count[order].sum(1)), 5))]]
        ((docs, got),) = model.nearest(*query, 5)
        assert sorted(docs.tolist()) == [i for i in range(len(sims)) if sims[i] > 0 and sims[i] >= kth - 1e-9]
        assert np.allclose(got, sims[docs])


def test_toxicity_by_brute_force(spark):
    """The whole operator on dense vectors: every example, every cosine, votes, leave-one-out calibration."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 30)) + rng.choice(["", " vile", " vile filth"]) * (i % 3 == 0)) for i in range(120)] + [(200, None), (201, ""), (202, "?!"), (203, "zzz")]
    rows += [(300 + i, rows[i][1]) for i in range(6)] + [rows[7]]
    labels = [(i, 1, int("vile" in (t or "") and i % 7 > 0)) for i, t in rows if i < 300 and i % 2 == 0]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    chosen = {(t, y): i for (i, _, y), t in sorted(((lab, dict(rows)[lab[0]]) for lab in labels if lab[0] not in held), reverse=True) if t}
    examples = [(toxicity.words(t), y) for t, y in chosen]
    n = Counter(y for _, y in examples)
    terms = sorted({w for x, _ in examples for w in x})
    df = {t: sum(t in toxicity.words(text) for _, text in rows) for t in terms}
    weight = {}
    for t in terms:
        a, b = (sum(t in x for x, y in examples if y == label) for label in (1, 0))
        both, total = a + b, len(examples)
        chi = total * (a * n[0] - b * n[1]) ** 2 / (n[0] * n[1] * both * (total - both)) if both < total else 0
        weight[t] = (np.log((1 + len(rows)) / (1 + df[t])) + 1) * max(1, chi / toxicity.CHANCE)

    def vector(x):
        v = np.array([(1 + np.log(x.count(t))) * weight[t] if t in x else 0.0 for t in terms])
        return v / np.linalg.norm(v) if v.any() else v

    able = [(vector(x), y) for x, y in examples if vector(x).any()]

    def vote(v, k, without=None):
        sims = sorted(((float(v @ u), y) for j, (u, y) in enumerate(able) if j != without and v @ u > 1e-12), reverse=True)
        near = [(c, y) for c, y in sims if c >= sims[min(k, len(sims)) - 1][0] - 1e-9] if sims else []
        return sum(c for c, y in near if y) / sum(c for c, _ in near) if near else None

    pairs = sorted((v, y) for j, (u, y) in enumerate(able) if (v := vote(u, toxicity.NEIGHBOURS, j)) is not None)
    blocks = []
    for v, y in pairs:
        if blocks and blocks[-1][0][-1] == v:
            blocks[-1][0].append(v)
            blocks[-1][1].append(y)
        else:
            blocks.append(([v], [y]))
        while len(blocks) > 1 and np.mean(blocks[-2][1]) >= np.mean(blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = (blocks[-1][0] + last[0], blocks[-1][1] + last[1])
    xs, ys = [np.mean(sorted(set(vs))) for vs, _ in blocks], [np.mean(y) for _, y in blocks]
    wordless = [y for x, y in examples if not x]
    got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    for r in got:
        raw = vote(vector(toxicity.words(r["text"])), toxicity.NEIGHBOURS)
        wanted = (np.mean(wordless) if wordless else 0.0) if raw is None else np.interp(raw, xs, ys)
        assert abs(r["score"] - wanted) < 1e-6, (r["doc_id"], r["score"], wanted)
    assert len({round(r["score"], 6) for r in got}) > 3


def test_texts_without_telling_terms_have_neighbours(spark):
    rows, labels = labelled()
    rows.append((901, "an entirely uncommon sentence"))
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame([*labels, (901, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {*"an entirely uncommon sentence".split()} <= set(model.vocabulary)
    query = lambda text: (*toxicity.flat([np.stack(np.unique(toxicity.numbers_of(text, model.vocabulary), return_counts=True), 1)]), 1)
    for text in (rows[-1][1], next(t for i, t in rows if i == 3)):
        ((docs, sims),) = model.nearest(*query(text), 5)
        assert abs(sims[0] - 1) < 1e-9
    assert model.ids[model.nearest(*query(rows[-1][1]), 5)[0][0][0]] == [901]


def test_sample_is_even(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 10 if i % 2 else 400)) for i in range(400)]
    passage = prose(rng, 3)
    rows += [(500 + i, f"{passage} {prose(rng, 40)}") for i in range(40)]  # different texts with a passage in common
    same = prose(rng, 50)
    rows += [(600 + i, same) for i in range(40)]
    labels = [(i, 1, 0) for i in range(640)]
    labels = [(i, q, int(i >= 600 and i % 2)) for i, q, _ in labels]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    every, sizes = toxicity.sample(docs, known, 10_000)
    # Copies count once in each label, other texts on their own.
    assert sizes == {0: len({i for i, _ in rows if i < 600} - held) + 1, 1: 1}
    assert every.count() == sum(sizes.values())
    some, _ = toxicity.sample(docs, known.where("doc_id < 400"), 80)
    short = some.where("doc_id % 2 = 1").count()
    assert some.count() == 80 and 20 <= short <= 60


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_pipeline(spark, tmp_path):
    """run() equals its stages, each of which does what its operator's own tests hold it to."""
    import corpus_pipeline

    rng = random.Random(4)
    rows, labels = labelled(200)
    rows = [r for r in rows if r[0] is not None]
    base, leak = prose(rng, 100), "bench " + prose(rng, 30)
    rows += [(1000, base), (1001, base), (1002, edited(rng, base, 2)), (1003, f"{prose(rng, 20)} {leak} {prose(rng, 20)}"), (1004, prose(rng, 70))]
    rows = [(i, f"{t}\nshared footer line number {i} of this site" if i and i > 150 and t else t) for i, t in rows]
    sf = str(tmp_path)
    frame(spark, rows, extra=False).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{sf}/{name}"
        stage(spark, kept, sf).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        if name == "line_dedup":
            assert kept.where("text like '%footer%'").count() == 0 and kept.where("n_chars <> length(text)").count() == 0
    ids = {r["doc_id"] for r in kept.collect()}
    toxic = {i for i, _, y in labels[:200] if y}
    assert ids == {i for i, _ in rows} - toxic - {1001, 1002, 1003}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == ids

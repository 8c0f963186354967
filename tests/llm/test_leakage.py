import random
import time
import tracemalloc

import numpy as np

from lodestrata.llm import leakage as K

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kelp larch maple nettle oak pine quince rowan spruce teak umbra vine willow yew zinnia".split()


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def plain(t):
    return "".join(c for c in t.lower() if c.isalnum())


def test_against_brute_force(spark):
    random.seed(11)
    text = lambda n: " ".join(random.choice(WORDS) + random.choice(["", ",", "."]) for _ in range(n))
    items = [(n, text(25), f"q{n}") for n in range(12)]
    documents = []
    for d in range(150):
        body = text(random.choice([0, 30, 120]))
        if d % 3 == 0:
            source = random.choice(items)[1].split()
            share = random.choice([0.3, 0.45, 0.55, 0.8, 1])
            at = random.randint(0, int(len(source) * (1 - share)))
            body = f"{body[: len(body) // 2]} {' '.join(source[at : at + int(len(source) * share)]).upper()} {body[len(body) // 2 :]}"
        documents.append((d, body))
    documents += [(900, None), (901, ""), (902, "。" * 10), (903, items[0][2]), (904, text(3000) + items[3][1] + text(3000)), (905, items[5][1]), (905, items[5][1])]
    got = K.leaks(spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items + items[:2], "item_id bigint, text string, question string"))
    found = {(r.doc_id, r.item_id) for r in got.filter("kind = 'stretch'").collect()}
    wanted = {(d, i) for d, t in documents if t and len(t) < 5000 for i, x, _ in items if longest_common(plain(t), plain(x)) * 2 >= len(plain(x))} | {(904, 3)}
    assert {x for x in found if x[0] != 904} | {(904, 3)} == wanted and (904, 3) in found


def test_shared_lengths_are_exact(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from here at dawn"
    row = K.leaks(spark.createDataFrame([(1, "zz " + item[10:60] + " qq")], "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).head()
    assert row.shared_chars == longest_common(plain("zz " + item[10:60] + " qq"), plain(item)) and row.item_chars == len(plain(item))


def test_empty(spark):
    docs = spark.createDataFrame([(1, "words")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some words to find here")], "item_id bigint, text string")
    assert K.leaks(docs, items.limit(0)).isEmpty() and K.leaks(docs.limit(0), items).isEmpty()
    assert K.leaks(docs, spark.createDataFrame([(1, "?!"), (None, "x"), (2, None)], "item_id bigint, text string")).isEmpty()


def test_halves_of_items_of_every_length_are_found(spark):
    random.seed(4)
    items = ["quartz jumpy", "ox", "a", "我们去了河边看雨", " ".join(random.choice(WORDS) for _ in range(400))]
    documents = []
    for n, item in enumerate(items):
        letters = plain(item)
        need = -(-len(letters) // 2)
        documents += [(n, f"... {letters[at : at + need]} ...") for at in range(0, len(letters) - need + 1, max(1, need // 5))]
    got = {(r.doc_id, r.item_id) for r in leaks(spark, documents, list(enumerate(items))).collect()}
    assert {(n, n) for n in range(len(items))} <= got


def leaks(spark, documents, items, **options):
    names = "item_id bigint, text string" + (", question string" if len(items[0]) == 3 else "")
    return K.leaks(spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items, names), **options)


def test_reworded_passages(spark):
    random.seed(9)
    fill = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
    items, documents = [], []
    for n in range(20):
        words = [random.choice(WORDS) for _ in range(40)]
        words[5], words[20], words[33] = str(1000 + n), f"name{n}", str(77000 + n)
        items.append((n, " ".join(words), "What was it?"))
        # Every seventh word replaced, so that no long stretch is left; once with the facts, once with others.
        reworded = [random.choice(WORDS) if k % 7 == 3 else w for k, w in enumerate(words)]
        documents.append((n, f"{fill(30)} {' '.join(reworded)} {fill(30)}"))
        other = [str(5 * int(w)) if w.isdigit() else w.replace("name", "eman") for w in reworded]
        documents.append((100 + n, f"{fill(30)} {' '.join(other)} {fill(30)}"))
    got = {(r.doc_id, r.item_id): r.kind for r in leaks(spark, documents, items).collect()}
    assert sum(got.get((n, n)) == "reworded" for n in range(20)) >= 18
    assert not any(d % 100 != i for d, i in got) and not any(d >= 100 for d, i in got)


def test_items_in_blocks_give_the_same(spark):
    random.seed(2)
    items = [(n, " ".join(random.choice(WORDS) for _ in range(30)), None) for n in range(7)]
    documents = [(n, f"before {items[n][1]} after") for n in range(7)]
    wanted = sorted(tuple(r) for r in leaks(spark, documents, items).collect())
    assert len(wanted) >= 7 and sorted(tuple(r) for r in leaks(spark, documents, items, block_items=2).collect()) == wanted


def test_common_terms_is_a_longest_common_subsequence():
    random.seed(1)
    for _ in range(200):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 90))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert K.common_terms(np.array(a), np.array(b)) == table[-1][-1]


def prepared(texts, questions=None):
    basis = np.random.default_rng(5).standard_normal((K.TERMS, K.RANK)).astype(np.float32)
    return K.Items(list(range(len(texts))), texts, questions or [""] * len(texts), np.ones(K.TERMS), basis)


def test_sums_are_right_and_take_a_fraction_of_reduceat():
    rng = np.random.default_rng(3)
    table = rng.standard_normal((5000, 48)).astype(np.float32)
    sizes = rng.integers(0, 65, 4000)
    sizes[:3], sizes[-2:] = 0, (1, 0)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    coordinate = rng.integers(0, len(table), begin[-1])
    full = np.flatnonzero(sizes)
    wanted = np.zeros((len(sizes), 48), np.float32)

    def least(f):
        times = []
        for _ in range(5):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    def plain_sums():
        wanted[full] = np.add.reduceat(table.take(coordinate, axis=0), begin[full], axis=0)

    slow = least(plain_sums)
    for piece in (K._PIECE, K.CELL):
        assert np.allclose(K._sums(begin, coordinate, table, piece), wanted, atol=1e-4)
    assert least(lambda: K._sums(begin, coordinate, table, K.CELL)) < slow / 2
    assert not K._sums(np.zeros(4, int), coordinate[:0], table, K.CELL).any()


def test_nearest_passages_against_brute_force_in_little_memory():
    random.seed(8)
    rng = np.random.default_rng(8)
    items = prepared([" ".join(random.choice(WORDS) for _ in range(random.choice([1, 12, 60, 200]))) for _ in range(500)])
    sizes = np.array([1, 3, 2500, 1, 17, 20000, 2, 1100])
    before = np.concatenate(([0], np.cumsum(sizes)))
    vectors = K._unit(rng.standard_normal((before[-1], K.RANK)).astype(np.float32))
    tracemalloc.start()
    text, item, cosine = items.nearest(vectors, before, 0.4)
    assert tracemalloc.get_traced_memory()[1] < 25e6
    tracemalloc.stop()
    wanted = {}
    for t in range(len(sizes)):
        for i in range(len(items.ids)):
            top = float((items.latent[items.edges[i] : items.edges[i + 1]] @ vectors[before[t] : before[t + 1]].T).max())
            if items.chars[i] < K.SHORT or top >= 0.4:
                wanted[t, i] = 1 if items.chars[i] < K.SHORT else top
    assert list(zip(text.tolist(), item.tolist())) == sorted(wanted) and np.allclose(cosine, [wanted[k] for k in sorted(wanted)], atol=1e-5)


def test_answers_between_places_against_brute_force():
    random.seed(6)
    texts = [" ".join([random.choice(WORDS) for _ in range(30)] + [str(random.randint(1, 30)) for _ in range(5)]) for _ in range(40)]
    items = prepared(texts, ["alder birch"] * 40)
    part = K.Slice([" ".join(random.choice([*WORDS, *map(str, range(30))]) for _ in range(random.choice([0, 50, 300]))) for _ in range(30)])
    hits = items.answer_hits(part)
    item, low = np.array([random.randrange(40) for _ in range(200)]), np.array([random.randrange(len(part.kept)) for _ in range(200)])
    high = low + 150
    wanted = [np.isin(items.answers[i], part.term[slice(*np.searchsorted(part.place, (a, b)))]).mean() for i, a, b in zip(item, low, high)]
    assert any(wanted) and items.answer_shares(hits, item, low, high).tolist() == wanted
    pairs = np.sort(np.unique([random.randrange(30 * 40) for _ in range(400)]))
    text_of = part.text_of(part.place)
    enough = [np.isin(items.answers[p % 40], part.term[text_of == p // 40]).sum() >= items.least_answer[p % 40] for p in pairs]
    assert any(enough) and items.answered(part, hits, pairs).tolist() == enough


def test_index_of_numbers_in_small_and_large_ranges():
    keys, asked = np.array([2, 5, 9]), np.array([0, 2, 9, 5, 8])
    for end in (10, 1 << 25):
        assert K._index(keys, asked, end).tolist() == [-1, 0, 2, 1, -1]
        assert K._index(keys[:0], asked, end).tolist() == [-1] * 5

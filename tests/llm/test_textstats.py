import numpy as np
import pytest

from lodestrata.llm import textstats as T

PROSE = "It rained all morning, so I stayed in and read old letters. Nobody called before noon. In the end I was glad of it.\n\n我把关于搬家的笔记交给大渔，请对方只看原文。后来雨停了，我们去了河边。"
KINDS = {
    "prose": [PROSE, "第一行写的是搬家的事。\n第二行写的是房租的事。\n第三行写的是睡眠的事。", PROSE + "\n- a\n- b\n", "Mixed.\n\n" + PROSE + "\na\tb\n1\t2\n"],
    "list": ["- one thing\n- another thing\n- a third thing", "1) 大渔：先问清楚。\n2) 小禾：先留下来。\n3) 老闵：早点睡。", "长堤 夜班 60\n星图 合租 37\n折纸 请假 42\n木星门 转岗 94"],
    "table": ["a,b,c\n1,2,3\n4,5,6\n7,8,9", "| x | y |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "name\tcount\nfir\t3\nelm\t4", "name        count     day\nfir         3         mon\nelm tree    14        tue"],
    "junk": ["", " \n\r\n", None, "=====\n=====\n=====", "the move " * 40, "2024-01-01T00:00 [WARN] worker-1 hash=0xff rc=1\n2024-01-01T00:01 [INFO] worker-2 hash=0xfe rc=2", "<div class=\"x\"><div>\n{};{};\nvar a=[];", "J'Ã©tais Ã  la maison et tu Ã©tais lÃ  avec l'Ã©tÃ©.", "¶a□b�c¤d e□f¶g the"],
}
CASES = [(kind, text) for kind, texts in KINDS.items() for text in texts]


@pytest.mark.parametrize("kind,text", CASES)
def test_kinds(kind, text):
    assert T.classify(T.measure([text or ""], T.Vocabulary(["the", "in", "我"])))[0] == kind


def test_figures():
    f = {k: v[0] for k, v in T.measure(["The cat sat.\n\nA dog, no end"], T.Vocabulary(["the", "A"])).items()}
    assert (f["n_chars"], f["n_words"], f["n_lines"]) == (27, 7, 2)
    assert f["mean_word_length"] == pytest.approx(18 / 7) and f["end_punct_share"] == 0.5 and f["common_word_share"] == pytest.approx(2 / 7)


def test_a_text_does_not_depend_on_its_neighbours():
    texts = [t or "" for _, t in CASES]
    words = T.Vocabulary(["the", "我们"])
    together = T.measure(texts, words)
    for n, text in enumerate(texts):
        alone = T.measure([text], words)
        for name in T.FIGURES:
            assert np.isclose(together[name][n], alone[name][0]), (name, text)


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "SLICE_CHARS", 50)
    rows = [(n, t, "x") for n, (_, t) in enumerate(CASES)] + [(None, "words here.", "x")]
    got = T.document_figures(spark.createDataFrame(rows, "doc_id bigint, text string, n_words string"), ["the", "in", "我"]).collect()
    assert {r.doc_id: r.text_kind for r in got if r.doc_id is not None} == {n: k for n, (k, _) in enumerate(CASES)} and len(got) == len(rows)
    assert T.document_figures(spark.createDataFrame([], "doc_id bigint, text string"), []).collect() == []


WIDE = ["Repair the import of the archive before anything new is begun", "Ring the landlord about the lease and the broken lamp downstairs", "Water the mint on the sill while Keziah is away for the whole week",
        "Bring back the books on sleep that were due at the library in May", "Write three lines before bed and leave the telephone in the kitchen"]
NESTED = "Monday.\n    Ring the landlord about the lease.\n    Water the mint on the sill.\nTuesday.\n    Bring back the books on sleep.\n    Repair the import of the archive.\nFriday.\n    Write three lines before bed.\n    Leave the telephone in the kitchen."
WRAPPED = "    It rained all morning, so I stayed in\nand read old letters. Nobody called.\n    In the end I was glad of it, although\nthe lamp was broken. I slept early.\n    We went to the river after that, and\nnobody said a word. It was enough."
SIGNS = "q$7 ~k^ +=z $$w ^b~ k+3 =q$ z~^ w$= b^+ " * 2 + "q+b z=k w^q 7~z k$b =w^ +q~ ^z$ ~b= $k+"


@pytest.mark.parametrize("kind,text", [("list", "\n".join(WIDE)), ("list", NESTED), ("prose", WRAPPED), ("junk", SIGNS)])
def test_kinds_by_shape_and_ratios(kind, text):
    assert T.classify(T.measure([text], T.Vocabulary(["the", "in", "and", "of"])))[0] == kind


def test_indents_that_come_in_turn():
    f = T.measure([NESTED, "a\n" * 9, "    a\n" * 9, ""], T.Vocabulary([]))["indent_periodicity"]
    assert f[0] > 0.9 and list(f[1:]) == [0, 0, 0]


def test_gaps_far_along_a_line_are_columns_of_their_own():
    paragraph = lambda n: ("word " * n)[:-1] + ".  Here  it ends, after two gaps, and so the day was over."
    apart, below = T.measure([paragraph(900) + "\n" + paragraph(1000), paragraph(900) + "\n" + paragraph(900)], T.Vocabulary([]))["table_share"]
    assert apart == 0 and below == 1


def labelled(n, seed):
    """Texts of four kinds with their labels: prose, wide lists without markers, tables, and signs."""
    import random

    random.seed(seed)
    words = "lamp lease river letter mint sleep archive kitchen noon budget walk draft".split()
    phrase = lambda k: " ".join(random.choice(words) for _ in range(k))
    out = []
    for i in range(n):
        kind = T.KINDS[i % 4]
        if kind == "prose":
            text = "\n".join(" ".join(f"I saw the {phrase(4)} and it was {phrase(2)}." for _ in range(4)) for _ in range(random.randint(1, 4)))
        elif kind == "list":
            text = "\n".join(f"the {phrase(9)} and it is to {phrase(3)}; then {phrase(3)}." for _ in range(random.randint(4, 9)))
        elif kind == "table":
            text = "\n".join(f"{phrase(1)} ~ {random.randint(1, 99)} ~ {phrase(2)}" for _ in range(random.randint(4, 9)))
        else:
            text = " ".join("".join(random.choice("q$7~k^+=zw") for _ in range(4)) for _ in range(40))
        out.append((i, text, kind))
    return out


def test_learned_kinds_on_held_out_documents(spark):
    rows = labelled(600, 1)
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    # A few labels are wrong, some repeated, some of unknown kinds or documents.
    labels = [(i, "junk" if i % 41 == 0 else k) for i, _, k in rows if i < 400] + [(4, rows[4][2])] * 2 + [(7, None), (9999, "list"), (8, "poem"), (None, "list")]
    model = T.fit_kinds(documents.drop("kind"), spark.createDataFrame(labels, "doc_id bigint, text_kind string"), ["the", "and", "it"])
    f = T.measure([t for _, t, _ in rows], T.Vocabulary(["the", "and", "it"]))
    held = np.array([i >= 400 for i, _, _ in rows])
    right = lambda kinds: np.mean((kinds == np.array([k for _, _, k in rows]))[held])
    assert right(T.classify(f, model)) >= 0.97 > right(T.classify(f))
    again = T.fit_kinds(documents.drop("kind").repartition(7), spark.createDataFrame(labels[::-1], "doc_id bigint, text_kind string"), ["the", "and", "it"])
    assert (again.values == model.values).all() and (again.figures == model.figures).all()


def test_without_labels_the_rules_decide(spark):
    documents = spark.createDataFrame([(1, PROSE)], "doc_id bigint, text string")
    model = T.fit_kinds(documents, spark.createDataFrame([], "doc_id bigint, text_kind string"), [])
    assert [r.text_kind for r in T.document_figures(documents, [], model).collect()] == ["prose"]


@pytest.mark.parametrize("name", ["table_share", "indent_periodicity", "length_autocorrelation", "symbol_ratio", "end_punct_share", "mean_word_length", "common_word_share"])
def test_each_named_signal_can_decide(name):
    from lodestrata.llm import boosting

    rng = np.random.default_rng(3)
    x = rng.random((400, len(T.SIGNALS)))
    at = T.SIGNALS.index(name)
    wanted = np.where(x[:, at] > 0.6, 1, 0)
    model = boosting.fit(x, wanted, 4, np.zeros((400, 4)))
    flat = x.copy()
    flat[:, at] = 0
    assert (model.scores(x, np.zeros((400, 4))).argmax(1) == wanted).mean() > 0.98
    assert (model.scores(flat, np.zeros((400, 4))).argmax(1) == 0).all()

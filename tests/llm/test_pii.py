import os
import re

import numpy as np
import pytest

from countweave.llm import pii, pii_lines, pii_train
from countweave.llm.pii_text import ahv_valid, fold, near, sentences, spellings, tokens

DATA = os.environ.get("COUNTWEAVE_TESTDATA", "/root/testdata/sf0.001")

KIND = {"N": "name", "A": "address", "E": "email", "P": "phone", "D": "id_number"}


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def finder(model, given=("Felix", "Corina"), family=("Mosnmann", "Mosninger", "Mosneler", "Pfandmann", "Pfandinger", "Pfandeler", "Zollkmann", "Zollkinger", "Zollkeler")):
    return pii._finder(model, list(given), list(family))


def test_held_out_lines(model):
    """Lines of another seed: spans exactly as generated."""
    lexicon, lines = pii_lines.sample(600, 99)
    find = pii._finder(model, sorted(lexicon.given), sorted(lexicon.family))
    find.lexicon = lexicon
    hit = said = true = 0
    for (_, want), got in zip(lines, find([t for t, _ in lines])):
        w = {(KIND[k], a, b) for k, a, b in want}
        hit, said, true = hit + len(w & set(got)), said + len(got), true + len(w)
    assert hit / said > 0.93 and hit / true > 0.93, (hit, said, true)


def spans(model, text):
    return [(k, text[a:b]) for k, a, b in next(iter(finder(model)([text])))]


def test_forms(model):
    assert spans(model, "Bitte Fotos an lina_mosn[at]velopost[dot]example schicken.") == [("email", "lina_mosn[at]velopost[dot]example")]
    assert spans(model, "Mail: urs.mosnmann&#64;bluebox.invalid") == [("email", "urs.mosnmann&#64;bluebox.invalid")]
    assert spans(model, "Ruf mich an: +41 (0)52 555 33 74 (abends).") == [("phone", "+41 (0)52 555 33 74")]
    assert spans(model, "Versichertennummer: 756.1234.5678.97.") == [("id_number", "756.1234.5678.97")]
    assert spans(model, "Herr Pfandmann vom Tiefbau sagte, das sei bekannt.") == [("name", "Pfandmann")]
    assert spans(model, "Ich wohne Lindenstrasse 9 c, 8789 Weiherswil und höre die Baustelle.") == [("address", "Lindenstrasse 9 c, 8789 Weiherswil")]
    assert spans(model, "> Corina Zollkinger\n> Mail: c@mail.quitten.example") == [("name", "Corina Zollkinger"), ("email", "c@mail.quitten.example")]


def test_no_cases(model):
    for t in ("Der Herr Stadtrat hat dazu am 2015-06-12 leider nichts gesagt.", "Gruss\nFelix", "Hoi velo_zora839", "Artikel 7603937534664 ist wieder lieferbar.", "Referenz auf dem Einzahlungsschein: 00 07755 517 0077.", "Treffpunkt Lindenstrasse 16 Uhr, wie immer.", "756.1234.5678.90 hat eine falsche Prüfziffer"):
        assert spans(model, t) == [], t


def test_redaction_keeps_the_rest(spark):
    text = "> Kontakt: Corina Zollkinger, c@x.example\n-- \nFelix"
    rows = [(1, text), (2, None), (3, ""), (4, "  \n"), (5, text), (6, "wort " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind")
    names = spark.createDataFrame([("Felix", "given"), ("Corina", "given"), (None, "family")] + [(f"Zollk{e}", "family") for e in ("inger", "mann", "eler")] + [(f"Mosn{e}", "family") for e in ("inger", "mann", "eler")], "name string, name_kind string")
    got = {r["doc_id"]: (r["text"], r["n_items"]) for r in pii.redacted(docs, "doc_id", "text", names).collect()}
    assert got[1] == got[5] == ("> Kontakt: [NAME], [EMAIL]\n-- \nFelix", 2)
    assert got[2] == (None, 0) and got[3] == ("", 0) and got[4] == ("  \n", 0) and got[6][1] == 0
    found = pii.found(docs, "doc_id", "text", names).collect()
    assert sorted((r["kind"], text[r["start_pos"] : r["end_pos"]]) for r in found if r["doc_id"] == 1) == [("email", "c@x.example"), ("name", "Corina Zollkinger")]
    assert pii.found(docs.limit(0), "doc_id", "text", names).count() == 0


def test_pieces():
    assert set(spellings("meier")) & set(spellings("meyer")) and not set(spellings("meier")) & set(spellings("huber"))
    assert fold("KÃ¤thi") == fold("Käthi") == "kaethi" and near("stadtrat", "stadrtat") and not near("mosnmann", "stadtrat")
    assert ahv_valid("756.1234.5678.97") and not ahv_valid("756.1234.5678.90")
    text = "ä 🚴 a.b@c.de\n+41 44 555 11 22"
    assert all(text[a:b] == s for _, a, b, s in tokens(text))


def test_training_texts_share_nothing_with_the_documents():
    """No piece of a sentence that the tagger is trained on occurs in the test documents."""
    path = f"{DATA}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    corpus = "\n".join(t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t)
    pieces = [x.strip() for t in pii_lines.PERSONAL + pii_lines.PLAIN for x in re.split(r"\{\w+\}|\n", t)]
    assert [x for x in pieces if len(x) > 12 and x in corpus] == []


def test_names_like_roles(model):
    for name in ("Meier", "Maurer", "Maria"):
        t = f"Der Vertrag wurde von Peter {name} unterzeichnet."
        assert ("name", f"Peter {name}") in spans_with(model, t, given=("Peter", "Maria"), family=("Meier", "Maurer", "Maria"))
    assert spans(model, "Liebe Frau Gemeindepräsidnetin, wo bleibt die Quittung?") == []


def spans_with(model, text, given, family):
    return [(k, text[a:b]) for k, a, b in next(iter(pii._finder(model, list(given), list(family))([text])))]


def test_skip_edges_are_learned_and_used(model):
    """Equal and similar words of a document share their labels: what is learned favours the same
    item, and a second mention is found that no sentence of its own tells."""
    assert model.skip[pii.EQUAL, 1] > 0.5 and model.skip[pii.SIMILAR, 1] > 0.5
    doc = pii.Documents(pii.Lexicon([], []), {})
    doc.add("Der Vertrag von Xaver Brukelmann.\nDanach kam Brukelman, Danach ging Brukelmann.", whole=True)
    kinds = doc.links()[2].tolist()
    assert kinds.count(pii.SIMILAR) == 2 and kinds.count(pii.EQUAL) == 1  # each to the mention before


def test_sentences_without_an_item_are_left_out():
    text = "ohne etwas darin. Immer noch nichts! Herr Muster kam.\nund um acht\nMail: a@b.ch"
    assert [text[a:b] for a, b in sentences(text)] == ["Herr Muster kam.", "Mail: a@b.ch"]
    assert sentences("") == []


def test_kinds_of_the_name_list(spark):
    names = spark.createDataFrame([("Ada", "given"), ("Bo", " Family "), ("Cy", None), ("Di", "nick"), (None, "given")], "name string, name_kind string")
    assert pii.lexicon_rows(names) == (["Ada", "Cy", "Di"], ["Bo", "Cy", "Di"])
    with pytest.raises(ValueError):
        pii.lexicon_rows(names, largest=3)


def test_stored_model_is_what_training_gives():
    """A small training run is deterministic, and the stored file holds tables of the present shape."""
    a, b = pii_train.fit(60, 3), pii_train.fit(60, 3)
    assert all(np.array_equal(a.tables[k], b.tables[k]) for k in a.tables) and np.array_equal(a.skip, b.skip)
    m = pii.trained()
    assert {k: t.shape for k, t in m.tables.items()} == {k: (n, pii.K) for k, n in pii.sizes(len(m.vocabulary) + 1).items()}


def test_workers_need_no_package(tmp_path):
    """What runs in tasks travels by value: workers that cannot import the package find the same."""
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
    import sys
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession
    s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()

    def probe(_):
        import importlib.util
        return [importlib.util.find_spec("countweave") is None]

    assert all(s.sparkContext.parallelize(range(2), 2).mapPartitions(probe).collect())
    from countweave.llm import bpe, mixing, pii
    d = s.createDataFrame([(1, "Kontakt: Corina Zollkinger, c@x.example", "a")], "doc_id long, text string, source string")
    n = s.createDataFrame([("Corina", "given"), ("Zollkinger", "family")], "name string, name_kind string")
    assert pii.found(d, "doc_id", "text", n).count() == 2 and pii.redacted(d, "doc_id", "text", n).first()["text"] == "Kontakt: [NAME], [EMAIL]"
    t = s.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(bpe.token_counts(d, ["doc_id", "source"], "text"), t).count() == 1
    print("fine")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "fine" in out.stdout, out.stderr[-2000:]

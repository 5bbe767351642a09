import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from diagtab.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = builder("tests", 4, 4).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tokens(spark):
    """Hand-annotated sentences: (id, sent_i, i, text, lemma, pos, tag, dep, head_i)."""

    def sentence(record, sent_i, rows):
        return [("d", record, sent_i, i, *row) for i, row in enumerate(rows)]

    rows = sentence("air", 0, [
        ("An", "an", "DET", "DT", "det", 1), ("aircraft", "aircraft", "NOUN", "NN", "nsubj", 2),
        ("performs", "perform", "VERB", "VBZ", "ROOT", 2), ("several", "several", "ADJ", "JJ", "amod", 4),
        ("flights", "flight", "NOUN", "NNS", "dobj", 2), (".", ".", "PUNCT", ".", "punct", 2)])
    rows += sentence("bank", 0, [
        ("A", "a", "DET", "DT", "det", 1), ("bank", "bank", "NOUN", "NN", "nsubj", 2),
        ("consists", "consist", "VERB", "VBZ", "ROOT", 2), ("of", "of", "ADP", "IN", "prep", 2),
        ("accounts", "account", "NOUN", "NNS", "pobj", 3), ("and", "and", "CCONJ", "CC", "cc", 4),
        ("clients", "client", "NOUN", "NNS", "conj", 4)])
    rows += sentence("shop", 0, [
        ("Customers", "customer", "NOUN", "NNS", "nsubj", 1), ("buy", "buy", "VERB", "VBP", "ROOT", 1),
        ("books", "book", "NOUN", "NNS", "dobj", 1), ("and", "and", "CCONJ", "CC", "cc", 1),
        ("send", "send", "VERB", "VBP", "conj", 1), ("letters", "letter", "NOUN", "NNS", "dobj", 4),
        ("to", "to", "ADP", "IN", "prep", 4), ("friends", "friend", "NOUN", "NNS", "pobj", 6)])
    rows += sentence("kind", 0, [
        ("Dog", "dog", "NOUN", "NN", "nsubj", 1), ("is", "be", "AUX", "VBZ", "ROOT", 1),
        ("a", "a", "DET", "DT", "det", 3), ("animal", "animal", "NOUN", "NN", "attr", 1)])
    rows += sentence("kind", 1, [
        ("Pet", "pet", "NOUN", "NN", "nsubj", 2), ("can", "can", "AUX", "MD", "aux", 2),
        ("be", "be", "AUX", "VB", "ROOT", 2), ("cat", "cat", "NOUN", "NN", "attr", 2)])
    rows += sentence("kind", 2, [
        ("Vehicle", "vehicle", "NOUN", "NN", "ROOT", 0), ("maybe", "maybe", "ADV", "RB", "advmod", 0),
        ("car", "car", "NOUN", "NN", "appos", 0)])
    rows += sentence("part", 0, [
        ("Order", "order", "NOUN", "NN", "nsubj", 1), ("includes", "include", "VERB", "VBZ", "ROOT", 1),
        ("items", "item", "NOUN", "NNS", "dobj", 1), ("and", "and", "CCONJ", "CC", "cc", 2),
        ("Order", "order", "NOUN", "NN", "conj", 2)])
    schema = "dataset string, id string, sent_i int, i int, text string, lemma string, pos string, tag string, dep string, head_i int"
    return spark.createDataFrame(rows, schema)

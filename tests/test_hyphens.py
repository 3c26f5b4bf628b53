import pytest
from stemmata.operators import hyphens

# Text of a candidate, other candidates of its document, the text expected, and how many breaks are closed.
CASES = [
    ("unfor-\ntunate", "", "unfortunate", 1),
    ("self-\nevident and Self-\nmade", "", "self-evident and Self-made", 0),
    ("mother-\nin-law", "", "mother-in-law", 0),
    ("mother-\nin‐law", "", "mother-in‐law", 0),
    ("life-\nlike", "a LIFE-like doll", "life-like", 0),
    ("re-\nturn", "they Return here", "return", 1),
    ("re-\nturn", "", "re-turn", 0),
    ("19-\n20 and Anglo-\nSaxon —\nstill", "", "19-20 and Anglo-Saxon —still", 0),
    ("a dash—\nhere and a line-\nend", "", "a dash—here and a lineend", 1),
    ("soft\u00ad\nhyphen ‐ and odd‐\nones, don't-\nstop", "", "softhyphen ‐ and oddones, don'tstop", 3),
    ("a-\nb-\nc", "", "a-b-\nc", 0),
    ("coat-\nRack", "the coatrack", "coatRack", 1),
    ("coat-\nrack", "the coatrack, a coat-rack", "coat-rack", 0),
    ("no break - here\nor there", "", "no break - here\nor there", 0),
    ("straße-\nbahn", "STRASSEBAHN", "straßebahn", 1),
    ("", "", "", 0),
]


@pytest.fixture(scope="module")
def repaired(spark):
    rows = [(i, 0, "PARAGRAPH", t) for i, (t, *_) in enumerate(CASES)] + [(i, 1, "PARAGRAPH", more) for i, (_, more, *_) in enumerate(CASES)]
    rows += [(100, 0, "VERSE_LINE", "un-\nbroken—\nverse"), (101, 0, "ARTIFACT", "un-\nbroken")]
    table = spark.createDataFrame(rows, "doc_id long, cand int, kind string, text string")
    return {r.doc_id: (r.text, r.joined) for r in hyphens.dehyphenate(table, table).filter("cand = 0").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_breaks(repaired, i):
    assert repaired[i] == CASES[i][2:]


def test_kinds_left_alone(repaired):
    assert repaired[100] == ("un-\nbroken—\nverse", 0) and repaired[101] == ("un-\nbroken", 0)

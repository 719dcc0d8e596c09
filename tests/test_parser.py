import pytest

from pagewright.operators.match import AnyOf, Near, Phrase, leaves_of
from pagewright.plans import paging
from pagewright.plans import parser as p


def nodes(text):
    return p.parse(text).nodes


def test_words_phrases_prefixes_and_proximity():
    assert nodes('steel "heat loss" corro* near:7 pump valve') == [p.Term("steel"), p.Quoted("heat loss"), p.Prefix("corro"), p.Proximity(("pump", "valve"), 7)]
    assert nodes("near:x a b -c") == [p.Proximity(("a", "b"), 5)] and nodes("pres:0 a b") == [p.Proximity(("a", "b"), 1)]
    assert nodes("near:3 alone") == [p.Term("alone")]
    assert nodes("“heat loss”") == [p.Quoted("heat loss")] and nodes('"open end') == [p.Quoted("open end")]
    assert p.node_of(p.Term("a_b")) == Phrase.of("a", "b")


def test_filters_and_exclusions():
    q = p.parse('steel dossier:Works folder:"My files" ext:.PDF -ext:md nom:plan -path:old -rust -"dry run" chemin:x/Y')
    assert (q.folders, q.exts, q.not_exts, q.names, q.not_paths, q.paths) == (["Works", "My files"], ["pdf"], ["md"], ["plan"], ["old"], ["x/Y"])
    assert q.excluded[0] == p.Term("rust") and q.nodes[0] == p.Term("steel")
    assert p.parse("name:plan").names_only and not p.parse("name:plan steel").names_only
    assert p.parse("body:steel").body_only and p.parse('texte:"heat loss"').nodes == [p.Quoted("heat loss")]


@pytest.mark.parametrize("text,kind", [("", "emptyQuery"), ("...", "emptyQuery"), ("-rust", "exclusionOnly"), ("folder:x", "exclusionOnly"), ("a AND b", "ftsOperator"), ("NEAR(a b)", "ftsOperator"),
                                       ("colour:red x", "unknownPrefix"), ("text:x", "unknownPrefix"), ("-body:x y", "notExcludable"), ("abc*", "prefixTooShort")])
def test_refusals(text, kind):
    with pytest.raises(p.QueryError) as e:
        p.parse(text)
    assert e.value.kind == kind


def test_no_prefixes_in_addresses_and_times():
    assert len(nodes("https://example.org/x 12:30 a:b")) == 3


def test_amounts():
    assert p.amount_variants("1512,50") == ("1512,50", "1 512,50") and p.amount_variants("512,50") is None
    assert p.node_of(p.Term("1512,50")) == AnyOf((Phrase.of("1512", "50"), Phrase.of("1", "512", "50")))
    assert nodes("total 1 512,50 paid") == [p.Term("total"), p.Term("1512,50"), p.Term("paid")]


def test_forms():
    assert p.variants("polymer") == ["polymers"] and p.variants("batteries") == ["battery", "batterie"]
    assert p.variants("chevaux") == ["cheval", "chevau"] and p.variants("boxes") == ["boxe", "box"] and p.variants("prix") == [] and p.variants("cheveux") == ["cheveu"] and p.variants("journal") == ["journaux", "journals"]
    assert p.forms(["pump", "pump"]) == [["pump", "pumps"]] * 2 and p.variants("process") == ["processes"] and p.variants("pneu") == ["pneux", "pneus"]
    assert p.variants("temps") == [] and p.variants("abc") == [] and p.variants("r2d2") == []
    assert p.forms(["pump", "pumps"]) == [["pump"], ["pumps"]]


def test_quorum():
    assert p.quorum_words(["pump", "valve"]) is None
    assert p.quorum_words(["pump", "valve", "rotor"]) == (["pump", "valve", "rotor"], 2)
    words, need = p.quorum_words(["pump", "valve", "rotor", "with", "bearings", "temperature", "lubrication", "seal", "xx"])
    assert len(words) == 6 and need == 4 and "with" not in words
    spelled = p.subsets(["a", "b", "c"], 2)
    assert len(spelled) == 3


def test_condition():
    node = p.condition(p.parse("pumps near:4 a b"))
    assert isinstance(node.parts[0], AnyOf) and node.parts[1] == Near(("a", "b"), 4)
    assert {x.text for x in leaves_of(node)} == {"pumps", "pump", "a", "b"}
    with pytest.raises(p.QueryError):
        p.resolve_folders(["Nowhere"], ["Works"])
    assert p.resolve_folders(["WORKS"], ["Works"]) == ["Works"] and p.resolve_folders(["x"], []) == ["x"]


def test_cursors_and_budgets():
    args = {"query": "é", "limit": 5}
    assert paging.decode(paging.encode(15, args), args) == 15
    for bad in ("xx", paging.encode(15, {"query": "f"}), ""):
        with pytest.raises(ValueError):
            paging.decode(bad, args)
    render = lambda rows, n: "x" * (len(rows) * n)
    assert paging.fit(list(range(100)), render, 800, 30_000)[1:] == (100, 200)
    assert paging.fit(list(range(1000)), render, 800, 30_000)[1:] == (250, 80)

import pytest

from cairn.functions import text as tx
from cairn.functions.similarity import jaro_winkler, lcs, ratio, token_set_ratio, token_sort_ratio


@pytest.mark.parametrize("raw, want", [("clyialsystems.com", "clyialsystems"), ("A & B Pvt Ltd", "a and b private limited"), ("l l c", "llc"), ("N/A", "n/a"), ("null", None), ("  ", None), (None, None), ("Café Ste", "cafe societe"), ("hea1th 6reat 21b", "health great 21b")])
def test_names(raw, want):
    assert tx.normalize_name(raw) == want


@pytest.mark.parametrize("raw, want", [("27/5B Akshay Bldg", "27 5b akshay building"), ("Boston MA 02139", "boston ma 2139"), ("n° 14 Rd", "14 road"), (None, None), ("<null>", None)])
def test_addresses(raw, want):
    assert tx.normalize_address(raw) == want


@pytest.mark.parametrize("raw, want", [("lotus care care", "lotus care"), ("maison comice and fils", "maison comice"), ("private smart exports", "smart export"), ("zephon hotels", "zephon hotel"), ("limited", "limited"), (None, None)])
def test_core(raw, want):
    assert tx.name_core(raw) == want


def test_small_rules():
    assert tx.repair_encoding("â\x80\x99") == "’"
    assert [tx.stem(t) for t in ("partners", "lotus", "genesis", "glass", "bus")] == ["partner", "lotus", "genesis", "glass", "bus"]
    assert {tx.skeleton(t) for t in ("praivet", "praibhet", "piraivet")} == {"prbt"}
    assert tx.postcode("12 road 560 001 city 12345 x") == "12345" and tx.postcode("a 2139") is None and tx.postcode(None) is None
    assert tx.scripts_of("aआ中") == ["CJK", "DEVANAGARI"]
    c = tx.compose({"pvt": "x", "privat": "pvt", "a": "b", "b": "a", "saint": "st"}, tx.LEGAL_CANON)
    assert c["privat"] == "private" and c["pvt"] == "private" and "saint" not in c
    assert all(c.get(v, v) == v for v in c.values())


def test_jaro_winkler_is_duckdbs():
    import random

    import duckdb

    rng = random.Random(7)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    got = duckdb.execute("select list_transform(list_zip(?, ?), lambda p: jaro_winkler_similarity(p[1], p[2]))", [[a for a, _ in pairs], [b for _, b in pairs]]).fetchall()[0][0]
    assert max(abs(jaro_winkler(a, b) - g) for (a, b), g in zip(pairs, got)) < 1e-9


def test_jaro_winkler_is_duckdbs_to_the_last_bit():
    import random

    import duckdb

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcde 12") for _ in range(n))
    pairs = [(a + word(rng.randint(0, 70)), a + word(rng.randint(0, 70))) for a in (word(rng.randint(0, 30)) for _ in range(4000))]
    got = duckdb.execute("select list_transform(list_zip(?, ?), lambda p: jaro_winkler_similarity(p[1], p[2]))", [[a for a, _ in pairs], [b for _, b in pairs]]).fetchall()[0][0]
    assert [jaro_winkler(a, b) for a, b in pairs if a or b] == [g for (a, b), g in zip(pairs, got) if a or b]


def test_ratios():
    assert lcs("abcde", "ace") == 3 and ratio("", "") == 100 and ratio("ab", "cd") == 0
    assert token_sort_ratio("b a", "a b") == 100 and token_set_ratio("a b", "a b c") == 100 and token_set_ratio("", "") == 0

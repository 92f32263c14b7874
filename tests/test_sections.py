import pytest
from corpusflow.functions import sections


@pytest.mark.parametrize(
    "line, header",
    [
        ("Abstract", True),
        ("METHODS", True),
        ("method", True),
        ("results", True),
        ("conclusions are", True),  # letters and spaces only
        ("conclusion.", False),
        ("to the atmospheric neutrino", True),
        ("10 Gyr old clusters", True),
        ("1. Introduction", True),
        ("1.\u00a0abc", True),
        ("1.5 GeV", False),
        ("abc", False),  # shorter than four letters
        ("a, b and c", False),
        ("x" * 99, True),
        ("x" * 100, False),
        ("\u0661 Arabic digit", True),
        ("ab\u017ftract\u212a", True),
        ("r\u00e9sultats", False),
    ],
)
def test_headers(value, line, header):
    assert value(sections.is_header, line) is header


def split(value, text):
    return [tuple(s) for s in value(sections.split_sections, text)]


def test_sections(value):
    text = "First line, here.\nResults\nDiscussion\nIt holds, yes.\nMore.\nReferences"
    assert split(value, text) == [
        ("introduction", "First line, here."),
        ("Discussion", "It holds, yes.\nMore."),
    ]
    assert split(value, "Results\nDiscussion") == [("unknown", "Results\nDiscussion")]
    assert split(value, "") == [("introduction", "")]
    long = "w" * 60
    assert split(value, f"{long}\n1 2 3.") == [("w" * 50, "1 2 3.")]


def test_section_hint(value):
    hint = sections.section_hint
    assert value(hint, "\n\n1 2, 3.\n Methods \nx, y.") == "Methods"
    assert value(hint, "1,\n2,\n3,\n4,\n5,\nMethods") == "unknown"
    assert value(hint, "word " * 40) == ("word " * 40)[:50]


def test_paragraphs_and_sentences(value):
    assert value(sections.split_paragraphs, "\n\na\n \t\nb\nc\n\n\n\nd ") == ["a", "b\nc", "d"]
    assert value(sections.split_sentences, " One. Two!\nThree?  e.g.this 1.5 \u00a0") == [
        "One.", "Two!", "Three?", "e.g.this 1.5",
    ]
    assert value(sections.split_sentences, "  ") == []

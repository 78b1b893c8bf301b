"""Long attribute values and heads without an end tag."""

import pytest

from marlstone.llm.html_extraction import main_text

SAID = "A paragraph that is long enough, with words; and marks."


@pytest.mark.parametrize("quote", "\"'")
def test_long_attribute_values(quote):
    long = "x > y " * 2000
    assert main_text(f"<body><div class=menu data-json={quote}{long}{quote}><p>News, here.</p></div><article data-a = {quote}{long}{quote}><p>{SAID}</p></article>") == SAID


def test_stray_quote_ends_with_its_tag():
    assert main_text(f"<article><p title=it's>{SAID}</p><p>It's {SAID}</p></article>") == f"{SAID}\n\nIt's {SAID}"


@pytest.mark.parametrize("start", ["<body>", "", "</head>", "</head><body>"])
def test_head_ends_where_content_starts(start):
    assert main_text(f"<html><head><title>T</title><meta name=a><style>p {{}}</style><script>'<p>no</p>'</script>{start}<p>{SAID}</p>") == SAID

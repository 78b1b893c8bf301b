"""Pages that leave things open, and scans that stay linear."""

import time

import pytest

from marlstone.llm.html_extraction import main_text

P = "<p>The town council met on Monday, and it decided, after a long debate, to build the bridge.</p>"


@pytest.mark.parametrize("part", ["<a ", "<div class='", '<p title="', "<!-- ", "<button>", "<div><button>", "<svg>", "<script>", "<a href=x>", "<option>x", "</div>", "<li><p>", "<object><div>"])
def test_linear(part):
    took = []
    for n in (200_000, 1_000_000):
        page = f"<body><article>{P}</article>" + part * (n // len(part))
        began = time.process_time()
        main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < max(12 * took[0], 0.5), took


def test_a_megabyte_of_open_tags():
    began = time.process_time()
    main_text("<a " * 350_000)
    assert time.process_time() - began < 1


def test_slash_does_not_close_a_script():
    text = main_text(f"<body><article>{P}<script src='x.js' async/>var leaked = 1;</script>{P}</article></body>")
    assert "leaked" not in text and text.count("bridge") == 2


def test_slash_closes_foreign_elements():
    assert main_text(f"<body><article>{P}<svg viewBox='0'/>{P}</article></body>").count("bridge") == 2


@pytest.mark.parametrize("tag", ["button", "select", "object", "video", "canvas", "option"])
def test_unclosed_elements_end_with_their_parent(tag):
    for later in ("", f"<footer><{tag}>x</{tag}></footer>"):
        text = main_text(f"<body><article>{P}<div><{tag}>Go</div>{P}{P}</article>{later}</body>")
        assert text.count("bridge") == 3 and "Go" not in text


def test_fallback_of_an_object_is_skipped():
    text = main_text(f"<body><article><div>{P}<object><div>no player</div></object>{P}</div></article></body>")
    assert "no player" not in text and text.count("bridge") == 2


def test_a_list_of_links_inside_an_article_stays():
    items = "".join(f"<li><a href='/{k}'>Reference number {k}</a></li>" for k in range(6))
    for head in ("<h1>Title</h1>", f"<h1>Title</h1>{P}"):
        text = main_text(f"<body><nav><ul>{items.replace('Reference', 'Menu')}</ul></nav><article>{head}<ul>{items}</ul>{P}{P}</article></body>")
        assert all(f"Reference number {k}" in text for k in range(6)) and "Menu" not in text


def test_page_that_ends_in_a_tag():
    assert main_text(f"<article>{P}<p class='x") == P[3:-4]

"""Pages without an article element keep headlines and smaller parts."""

from marlstone.llm.html_extraction import main_text

MANY = [f"Paragraph {k} is long enough, with words; and marks." for k in range(9)]
LAST = "A last one that stands apart, with words; and marks."


def body(parts):
    return "".join(f"<p>{x}</p>" for x in parts)


def test_headline_before_its_text():
    page = f'<body><nav><a href="/">Home</a></nav><main><h1>Title</h1><div class=post>{body(MANY)}</div></main><footer>end</footer>'
    assert main_text(page) == "\n\n".join(["Title", *MANY])


def test_second_part():
    page = f'<body><div class=menu><a href="/">Home</a></div><div id=content><div class=part1>{body(MANY)}</div><div class=part2>{body([LAST])}</div></div><div class=sidebar>{body(["Other news, here."])}</div>'
    assert main_text(page) == "\n\n".join([*MANY, LAST])


def test_parts_of_a_body():
    assert main_text(f"<body><h2>Head</h2><div>{body(MANY)}</div><div class=comments><h3>Said</h3><p>I agree.</p></div>") == "\n\n".join(["Head", *MANY])

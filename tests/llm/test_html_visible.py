"""What of a page is visible: where hidden elements end, and which rules hide."""

import pytest

from tesselwork.llm import html_text


@pytest.mark.parametrize("tag", sorted(html_text.RAW | html_text.RCDATA))
def test_elements_of_plain_text_end_on_pages_whose_lower_case_is_longer(tag):
    page = f"<title>İstanbul</title><{tag}>x</{tag.upper()}><p>İzmir K"
    assert html_text.text_of(page).split("\n")[-1] == "İzmir K"
    assert "x" in html_text.text_of(page) or tag not in ("textarea", "xmp")


def test_end_tags_are_ascii():
    assert html_text.text_of("<script>a</ſcript>b</script>c") == "c"


def styled(css, body):
    return html_text.text_of(f"<head><style>{css}</style></head><body class=b>{body}</body>")


VISIBLE = [
    # rules for other media than a screen, and for screens
    ("@media print { .a { display:none } } .b .c { color: red }", "<i class=a>x</i>", "x"),
    ("@media screen and (min-width: 600px) { .a { display:none } }", "<i class=a>x</i>y", "y"),
    ("@media (max-width: 600px), print { .a { display:none } .b { color:red } }", "<i class=a>x</i>y", "xy"),
    ("@media not print { .a { display:none } }", "<i class=a>x</i>y", "y"),
    ("@media (400px <= width < 800px) or (hover: none) { .a { display:none } }", "<i class=a>x</i>", "x"),
    ("@media not screen and (unheard-of: 1) { .a { display:none } }", "<i class=a>x</i>", "x"),
    ("@supports (display: grid) { @media all { .a { display:none } } }", "<i class=a>x</i>y", "y"),
    ("@keyframes k { from { visibility:hidden } } @font-face { x: y } .a { animation: k }", "<i class=a>x</i>", "x"),
    # the cascade
    (".a { display:none } .a { display:block }", "<i class=a>x</i>", "x"),
    (".a { display:block } .a { display:none }", "<i class=a>x</i>y", "y"),
    ("#i { display:inline } .a { display:none } i { display:none }", "<i id=i class=a>x</i>", "x"),
    (".a { display:none }", "<i class=a style='display:inline'>x</i>", "x"),
    (".a { display : none ! IMPORTANT }", "<i class=a style='display:inline'>x</i>y", "y"),
    (".a { display:none; display:nonsense }", "<i class=a>x</i>y", "y"),
    (".a { display:block }", "<i class=a hidden>x</i>", "x"),
    ("/* .a { */ .a { content: '} .z {'; display:none /* } */ }", "<i class=a>x</i>y", "y"),
    ("@layer low { #i { display:none } } .a { display:inline }", "<i id=i class=a>x</i>", "x"),
    # selectors
    (".n .a { display:none } .n > .b { display:none }", "<p class=n><u><i class=a>x</i><i class=b>y</i></u><i class=b>z</i></p>", "y"),
    (".a.q, [data-k=v] { display:none }", "<i class=a>x</i><i class='q a'>y</i><i data-k=v>z</i>", "x"),
    (".m\\:a { display:none }", "<i class='m:a'>x</i>y", "y"),
    (".a:hover, .a::before, .a:not(.c) i { display:none }", "<i class=a>x</i>", "x"),
    ("body.b .a { display:none }", "<i class=a>x</i>y", "y"),
    # visibility is inherited, and children may show again
    (".a { visibility:hidden } .c { visibility:visible }", "<div class=a>x<i>y</i><b class=c>z</b></div>", "z"),
    (".a { display:none } .c { display:inline; visibility:visible }", "<div class=a><b class=c>z</b></div>y", "y"),
    (".a { visibility:hidden }", "<ul class=a><li>x<li style='visibility:visible'>y</ul>", "* y"),
    ("", "<table><tr><td>a<td style='visibility:hidden'>b<td>c<tr style='visibility:collapse'><td>d</table>", "a    c"),
    # formulas and drawings
    ("", "<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/><mi>y</mi><annotation>t</annotation></math>", "x= 1 2 y"),
    ("", "a<svg><title>t</title><defs><text>n</text></defs><rect/><text>one<tspan>1</tspan></text><line/><text>two</text></svg>b", "a\none1\ntwo\nb"),
    ("", "<svg><foreignObject><div>x</div></foreignObject></svg>", "x"),
    ("", "<svg><g><p>x</p>y", "x\n\ny"),
]


@pytest.mark.parametrize(("css", "body", "text"), VISIBLE, ids=range(len(VISIBLE)))
def test_visible_as_in_a_browser(css, body, text):
    assert styled(css, body) == text


def test_style_elements_for_print_hide_nothing():
    assert html_text.text_of("<style media=print>p{display:none}</style><noscript><style>p{display:none}</style></noscript><p>x") == "x"


def test_styles_take_time_in_proportion():
    deep = "<div class=a>" * 20_000 + "x"
    assert styled(".a .a .a .c { display:none }" * 20, deep) == "x"
    assert styled(".a { background: " + " " * 50_000 + "x; display:none }", "<i class=a>x</i>y") == "y"
    assert styled("{" * 50_000 + "@media " + "(" * 50_000, "x") == "x"

import pytest

from termweave import cli
from termweave.render import page, svg, tables


def row(i, status="significant"):
    return {"display": f"word {i}", "layer": "keyword", "status": status, "fdr": 10.0 ** -(i + 2), "fold": 2.0 + i, "k_study": 3, "n_study": 9, "k_bg": 5, "n_bg": 99, "p_value": 0.001, "merged": "</script>", "genes": "A, B", "symbols": "a, b"}


def test_boxes_do_not_overlap_and_lie_inside():
    boxes = [b for b in svg.in_lines([(f"some words {i}", 24 - i / 3) for i in range(40)], 500, 300) if b]
    assert len(boxes) > 12
    for i, (x, y, w, h) in enumerate(boxes):
        assert x >= 0 and x + w <= 500 and y >= 0 and y + h <= 300.001
        assert not any(x < a + c - 1e-6 and a < x + w - 1e-6 and y < b + d - 1e-6 and b < y + h - 1e-6 for a, b, c, d in boxes[:i])
    assert svg.in_lines([("far too wide for this", 40)], 100, 100) == [None]


@pytest.mark.parametrize("theme", ["light", "dark"])
def test_cloud_shows_every_word_and_a_legend(theme):
    picture = svg.cloud_svg([row(i) for i in range(60)] + [row(0, "trend")], "A & B", theme=theme)
    assert picture.count('class="word"') == 61 and "A &amp; B" in picture and picture.count("fold ") >= 6 and svg.PAPER[theme][0] in picture
    assert "no concept is significant" in svg.cloud_svg([])


def test_page_is_safe():
    text = page.page("a <title>", svg.cloud_svg([row(1)]), [row(1)], [{"id": "A", "symbol": "<b>", "name": ""}], 3)
    assert "<svg" in text and text.count("</script>") == 2 and "a &lt;title&gt;" in text and "&lt;b&gt;" in text and "and 2 more" in text


def test_dots_need_something():
    with pytest.raises(ValueError):
        svg.dots_svg([])
    grid = [{"set_id": s, "label": "x", "concept": "x y", "fdr": 0.01, "fold": f, "k_study": k, "significant": True} for s, f, k in (("a", 3.0, 2), ("b", None, 0))]
    assert svg.dots_svg(grid).count("<circle") == 1


def test_names_of_files():
    taken = set()
    assert [tables.file_stem(n, taken) for n in ("a/b", "a b", "", "é1")] == ["a_b", "a_b_2", "_", "é1"]


def test_command_line_needs_a_background():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["run", "genes.txt", "-a", "x", "-o", "y"])

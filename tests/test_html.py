"""Page text: visible nodes, embedded page data, and where the two meet."""

import json
import random

from quarry.functions.html import clean_html, data_text, folded, joined, overlap, visible_text


def page(body="", data=None):
    script = "" if data is None else f'<script id="__NEXT_DATA__" type="application/json">{data if isinstance(data, str) else json.dumps(data)}</script>'
    return f"<html><head><title>Harbour tides</title></head><body>{body}{script}</body></html>"


def test_only_visible_nodes_count():
    body = "<header>logo</header><aside>ads</aside><nav>go <i>up</i></nav><section><h2>Ferry</h2><p>Boats &lt;12 m leave<br/>from pier <em>four</em>.</p></section><style>b{}</style><footer>end</footer>"
    assert visible_text(page(body)).split("\n") == ["Harbour tides", "Ferry", "Boats <12 m leave", "from pier", "four", "."]


def test_second_line_equal_to_the_first_goes():
    assert visible_text("<title>Low  water</title><h1>low WATER</h1><h2>Low water</h2><p>x</p>").split("\n") == ["Low  water", "Low water", "x"]
    assert visible_text("<p>one</p>") == "one" and visible_text("<p>same</p><p>other</p><p>same</p>").split("\n") == ["same", "other", "same"]


def test_data_fields_in_document_order():
    data = {"q": {"metaDescription": "Buoys", "list": [{"descVal": {"value": "<ul><li>red</li><li>green</li></ul>"}}, {"other": "<p>no</p>"}, {"bodyContentVal": "Buoys"}]}, "pageDescrition": " <b>Moor</b> here "}
    assert data_text(page(data=data)) == "Buoys\n\nred\ngreen\n\nMoor\nhere"
    assert data_text(page(data={"descVal": 3, "metaDescription": {"value": None}, "bodyContentVal": ["x"]})) == ""
    assert data_text(page(data='{"descVal": ')) == "" and data_text(page("<p>plain</p>")) == ""


def test_parts_overlap_by_whole_lines():
    body = "<h1>Quay</h1><p>North wall</p><p>South wall</p>"
    data = {"bodyContentVal": "<p>NORTH  wall</p><p>south wall</p><p>Crane</p><p>Crane</p>"}
    lines = [x for x in clean_html(page(body, data)).splitlines() if x]
    assert lines == ["Harbour tides", "Quay", "North wall", "South wall", "Crane", "Crane"]
    assert clean_html(page("<p>Quay</p>", {"descVal": "<p>Slip</p><p>Quay</p>"})).splitlines() == ["Harbour tides", "Quay", "", "Slip", "Quay"]


def test_joined_is_the_longest_overlap():
    for left, right, want in (("a\nb\na\nb", "a\nb\nc", "a\nb\na\nb\n\nc"), ("p\nq\nr", "Q \n\nR\ns\n\nt", "p\nq\nr\n\ns\n\nt"), ("a\nb", "a\nb", "a\nb"), ("", "r", "r"), ("l\n", "m", "l\n\nm"), ("l", "", "l")):
        assert joined(left, right) == want
    assert folded(" Straße \t X") == folded("STRASSE x")


def test_markup_that_does_not_nest():
    assert visible_text("<p>a<nav><div>b</nav>c</b><br/>d") == "a\nc\nd"
    assert visible_text("<p>a<img src=x>b</p><hr>c") == "a\nb\nc"
    assert clean_html(None) == "" and clean_html("") == ""


def test_overlap_is_the_longest_in_linear_time():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ([r.choice("xy") for _ in range(r.randrange(9))] for _ in range(2))
        assert overlap(a, b) == max((n for n in range(1, min(len(a), len(b)) + 1) if a[-n:] == b[:n]), default=0)

    class Line(str):
        asked = 0

        def __eq__(self, other):
            Line.asked += 1
            return str.__eq__(self, other)

        def __ne__(self, other):
            return not self == other

        __hash__ = str.__hash__

    same = [Line("x") for _ in range(5000)]
    assert overlap([*same, Line("y")], same) == 0 and overlap(same, [*same[1:], Line("y")]) == 4999 and overlap(same, same) == 5000
    assert Line.asked < 3 * 6 * 5000  # three calls, six comparisons a line of both at most

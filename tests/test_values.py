"""Fixed values, written out once more: queries and their SQL may share them."""

from paperloom.functions import codes
from paperloom.plans import checks


def test_signals_and_weights():
    said = "부동표 220, 부동그림 180, 반복머리행 140, 셀나눔 160, 겹침허용 180, anchor고정 70, 쪽기준 110, 단기준 80, 문단기준 0, 병합셀 3, 큰셀 18, 캡션 0, 자르기 50, 회전 30, 반전 30, 본문배치 0"
    assert ", ".join(f"{label} {weight}" for label, weight in checks.SIGNALS.values()) == said
    assert list(checks.SIGNALS)[:5] == ["floating_tables", "floating_pictures", "repeat_header_tables", "page_break_tables", "overlap_allowed"]
    assert checks.OBJECTS == ["tables", "pictures", "equations", "charts", "forms", "shapes", "oles", "videos"]


def test_names_of_objects():
    assert codes.RELATIVE_TO == {"horz": ["paper", "page", "column", "para"], "vert": ["paper", "page", "para"]}
    assert codes.RELATIVE_NAMES == ["paper", "page", "para", "column", "absolute"]
    assert codes.ALIGNED == {"horz": ["left", "center", "right", "inside", "outside"], "vert": ["top", "center", "bottom", "inside", "outside"]}
    assert codes.ALIGNED_NAMES == ["left", "center", "right", "top", "bottom", "inside", "outside"]
    assert codes.WRAPS == ["top-and-bottom", "square", "tight", "through", "behind-text", "in-front-of-text"] and codes.FLOWS == ["both-sides", "left-only", "right-only", "largest-only"]
    assert codes.PARAGRAPHS == ["justify", "left", "right", "center", "justify", "justify"]
    assert {n: k for k, names in codes.SPACING.items() for n in names}["between-lines"] == "space-only" and codes.SPACING["minimum"][-1] == "min"

from quarry.metrics import Metrics


def test_text():
    m = Metrics("x")
    m.count("searches")
    m.count("searches", 2)
    m.gauge("symbols", 7)
    m.observe("search", 0.003)
    m.observe("search", 7.0)
    text = m.text()
    assert "x_searches_total 3" in text and "x_symbols 7" in text
    assert 'x_search_seconds_bucket{le="0.005"} 1' in text and 'x_search_seconds_bucket{le="+Inf"} 2' in text and "x_search_seconds_count 2" in text

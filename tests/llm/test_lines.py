from traceloom.llm.line_windows import drop_repeated_windows


def brute(docs):
    """Of distinct ids, the text left over: one window at a time."""
    first, windows = {}, []
    for i, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        lines = text.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(line.strip(" \t\n\v\f\r") for line in w):
                windows.append((i, p, w))
                first.setdefault(w, (i, p))
    gone = {(i, p + k) for i, p, w in windows if first[w] != (i, p) for k in range(3)}
    out = {}
    for i, text in docs:
        lines = [] if text is None else text.split("\n")
        kept = [line for p, line in enumerate(lines) if (i, p) not in gone]
        out[i] = (len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept))
    return out


def test_equals_brute_force(spark):
    docs = [
        (1, "a\nb\nc\nd"),
        (2, "x\na\nb\nc\nd\ny"),
        (3, "q\nq\nq\nq\nq"),
        (4, "\n\n\n\nz"),
        (5, "z\nb\nc\nd\nq\nq\nq"),
        (6, None),
        (7, ""),
        (8, "a\nb\nc\nd"),
        (9, "a\nb"),
    ]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in drop_repeated_windows(df).collect()}
    assert got == brute(docs)


def test_odd_rows(odd, empty):
    out = drop_repeated_windows(odd)
    assert out.columns == odd.columns + ["n_removed"]
    rows = out.collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[9].n_removed == 6 and by_id[10].text == ""
    assert by_id[4].text is None and by_id[4].n_lines == 0
    assert drop_repeated_windows(empty).collect() == []

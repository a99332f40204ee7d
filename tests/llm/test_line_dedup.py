from hunkwise.llm import line_dedup

from .cases import awkward, collected, frame


def brute(rows, min_sites):
    distinct = {(r[0], r[1]): r[2] if len(r) > 2 else "s1" for r in rows}
    sites, first = {}, {}
    for (doc, text), site in distinct.items():
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" "):
                sites.setdefault(line, set()).add(site)
                at = (doc is not None, doc or 0, pos)
                first[line] = min(first.get(line, at), at)
    bad = {line for line, s in sites.items() if len(s - {None}) >= min_sites}
    out = []
    for r in rows:
        lines = r[1].split("\n") if r[1] is not None else []
        gone = [line in bad and first[line] != (r[0] is not None, r[0] or 0, p) for p, line in enumerate(lines)]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g) if r[1] is not None else None
        out.append((r[0], kept, len(lines), sum(gone)))
    return sorted(out, key=repr)


def test_brute_force(spark):
    rows = [r if len(r) > 2 else (*r, "s1") for r in awkward()]
    for line in ("Cookies on this site", " Cookies on this site", "Share"):
        rows += [(100 + i, f"{line}\nown {i} {line}\n\n{line}\n", f"s{i % k}") for i in range(40) for k in (3, 12)]
    rows += [(300 + i, "no site\nx", None) for i in range(20)]
    for min_sites in (2, 10):
        found = line_dedup.dedup(frame(spark, rows), min_sites, carry=("doc_id", "text", "label"))
        assert collected(found, "doc_id", "text", "n_lines", "n_removed") == brute(rows, min_sites)


def test_many_sites_are_counted_near_the_threshold(spark):
    rows = [(i, f"at the edge {k}", f"s{i % k}") for k in range(190, 211) for i in range(k)]
    rows = [(n, text, site) for n, (_, text, site) in enumerate(rows)]
    found = line_dedup.dedup(frame(spark, rows), 200)
    assert collected(found, "doc_id", "text", "n_lines", "n_removed") == brute(rows, 200)


def test_empty(spark):
    assert line_dedup.dedup(frame(spark, [(1, "x")]).limit(0)).collect() == []

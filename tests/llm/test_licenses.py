import math

from tessera.llm import licenses as L


def brute(rows):
    seen = [(p, t) for p, t in rows if p is not None and t is not None]
    total = len(seen)
    df = {}
    for _, t in seen:
        for w in set(L.terms(t)):
            df[w] = df.get(w, 0) + 1
    vocabulary = {w for t in L.TEMPLATES.values() for w in L.terms(t)}
    stop = {w for w in vocabulary if df.get(w, 0) > max(L.MAX_DF * total, 1)}
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary - stop}
    other = math.log((1 + total) / 2) + 1

    def vector(t):
        v = {}
        rest = 0
        for w in L.terms(t):
            if w in idf:
                v[w] = v.get(w, 0) + idf[w]
            elif w not in stop:
                rest += other * other
        return v, math.sqrt(sum(x * x for x in v.values()) + rest)

    temp = {k: vector(t)[0] for k, t in L.TEMPLATES.items()}

    def best(t, least):
        v, size = vector(t)
        out = []
        for k, u in temp.items():
            norm = math.sqrt(sum(x * x for x in u.values()))
            if size and norm:
                c = round(sum(v.get(w, 0) * x for w, x in u.items()) / size / norm, 9)
                if c >= least:
                    out.append((-c, k))
        return min(out, default=None)

    own, dirs = {}, {}
    for p, t in seen:
        a = min((b for b in (best(x, L.LINE_COSINE) for x in t.split("\n")) if b), default=None)
        f = best(t, L.FILE_COSINE)
        own[p, t] = (a, f)
        if f:
            d = p.rpartition("/")[0]
            dirs[d] = min(dirs.get(d, (*f, p)), (*f, p))
    out = []
    for p, t in rows:
        a, f = own.get((p, t), (None, None))
        if a or f:
            c, k = a or f
            out.append((p, k, -c, "line" if a else "file", p))
            continue
        d = p
        hit = None
        while d and not hit:
            d = d.rpartition("/")[0]
            hit = dirs.get(d)
        out.append((p, hit[1], -hit[0], "directory", hit[2]) if hit else (p, None, None, None, None))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_scan(spark):
    prose = "some words that say nothing much at all about anything in here number "
    rows = [(f"z/{i}", prose + str(i)) for i in range(60)]
    rows += [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", prose + "one"), ("a/b/COPYING", L.TEMPLATES["GPL-3.0"]), ("a/b/d/e.py", prose + "two"), ("a/x.py", prose + "three"), ("q/x.py", prose + "four\nLicensed under the Apache License, Version 2.0.\n" + prose)]
    rows += [("q/y.py", prose + "licensed under cc by-nc 4.0"), ("q/z.py", None), (None, "Released under the MIT License."), ("q/z", ""), ("a/b/COPYING", L.TEMPLATES["GPL-3.0"]), ("long", prose * 5000)]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 as dir", "2 as w", "3 as license", "4 as at").repartition(3)
    got = sorted(((r.path, r.license, None if r.cosine is None else round(r.cosine, 6), r.license_from, r.license_path) for r in L.scan(df).collect()), key=key)
    want = sorted(((p, k, None if c is None else round(c, 6), f, q) for p, k, c, f, q in brute(rows)), key=key)
    assert got == want
    by = {r[0]: r for r in got}
    assert by["a/b/d/e.py"][1] == "GPL-3.0" and by["a/x.py"][1] == "MIT" and by["q/x.py"][3] == "line"
    assert L.scan(df.limit(0)).count() == 0


def test_common_notice(spark):
    prose = "some words that say nothing much at all about anything in here number "
    rows = [(f"hot/{i}", f"{prose}{i}\nLicensed under the Apache License, Version 2.0.\n{prose}") for i in range(40)]
    rows += [(f"mit/{i}", f"{prose}{i}\nMIT license") for i in range(3)] + [(f"mit{i}/x", f"mit anderen Leuten {i}") for i in range(20)]
    rows += [(f"z{i}/x", prose + str(i)) for i in range(57)] + [("gpl/x", L.TEMPLATES["GPL-3.0"])]
    got = {r.path: r for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert all(got[f"hot/{i}"].license == "Apache-2.0" and got[f"hot/{i}"].license_from == "line" for i in range(40))
    assert got["gpl/x"].license == "GPL-3.0" and all(got[f"z{i}/x"].license is None and got[f"mit{i}/x"].license is None for i in range(20))


def test_licence_texts_headers_and_tags(spark):
    prose = "some words that say nothing much at all about anything in here number "
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n" + prose
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n" + (prose + "\n") * 200
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n" + prose + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    rows = [("a/LICENSE", mit), ("a/b/c.py", prose), ("g/x.py", gpl), ("s/x.c", "// SPDX-License-Identifier: GPL-2.0-only\n" + prose), ("d/COPYING", bsd), ("z/x", prose)]
    got = {r.path: (r.license, r.license_from) for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "passage"), "a/b/c.py": ("MIT", "directory"), "g/x.py": ("GPL-3.0", "passage"), "s/x.c": ("GPL-2.0", "passage"), "d/COPYING": ("BSD-3-Clause", "passage"), "z/x": (None, None)}

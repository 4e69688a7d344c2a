"""Licence notices in their usual wrapping."""

from odd import odd
from pyspark.sql import functions as F

from logsluice.llm.licences import licence_paragraphs

WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin it.",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "gpl": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n *\n * the Free Software Foundation, either version 3",
    "lgpl": "// This library is free software: you can\n// redistribute it and/or modify it under the\n// terms of the GNU Lesser General Public\n// License as published by the Free Software\n// Foundation",
    "agpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided",
}


def test_wrapped_notices_are_found_where_they_begin(spark):
    prose = [f"The {i} way of saying that rights and things are free to share under heading {i} of this book" for i in range(60)]
    rows = [(i, f"Some words here {i}.\n{p}\nand more of it.", "en", "a") for i, p in enumerate(prose)]
    rows += [(1000 + k, f"{prose[k]}\n{text}\n{prose[k + 1]}", "en", "a") for k, text in enumerate(WRAPPED.values())]
    # One word a line; and twice on end.
    rows += [(2000, WRAPPED["bsd"].replace("# ", "").replace(" ", "\n"), "en", "a"), (2001, f"{WRAPPED['bsd']}\n{WRAPPED['bsd']}", "en", "a")]
    out = licence_paragraphs(odd(spark, rows)).where(F.col("doc_id") >= 1000).collect()
    found = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in out)
    named = [x for x in found if x[2] != "unknown"]
    assert named == [(1000 + k, 1, family) for k, family in enumerate(WRAPPED)] + [(2000, 0, "bsd"), (2001, 0, "bsd"), (2001, 3, "bsd")], found

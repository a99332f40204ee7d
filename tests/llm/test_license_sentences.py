"""Sentences about licences and the labels that a reader would give them."""

import pytest

from hunkwise.llm import catalog, licenses

from .cases import frame

CC = "This work is licensed under a Creative Commons"
FREE = "This program is free software; you can redistribute it and/or modify it under the"
FILE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
GRANT = "Permission is hereby granted, free of charge, to any person"

SENTENCES = {
    "Released under the Apache License 2.0.": "apache",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Licensed under the Eclipse Public License, version 2.0.": "",
    "Licensed under the Open Software License version 2.0": "",
    "Licensed under the Academic Free License version 3.0": "",
    "Licensed under the Apache-style terms of version 2 of our own contract": "",
    "The Apache helicopter is licensed under version 2 0 of the treaty.": "",
    "Apache Software Foundation: license terms apply, see version 2.0": "",
    f"Licensed to the ASF under the Apache License, Version 2.0; {FILE} http://www.apache.org/licenses/LICENSE-2.0": "apache",
    f"{FILE} http://www.apache.org/licenses/LICENSE-2.0": "apache",
    f"Licensed under the Educational Community License, Version 2.0; {FILE} http://opensource.org/licenses/ECL-2.0": "",
    f"{FILE} http://www.opensolaris.org/os/licensing.": "",
    f"Licensed under the EUPL, Version 1.2; {FILE} https://joinup.ec.europa.eu/": "",
    "This document is released under the license of the BSD project.": "",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met": "bsd",
    "Redistribution in source form is not permitted without the following conditions.": "",
    "Redistribution and use of this recipe in any form is permitted.": "",
    "the software was released by MIT under a license": "",
    "Released under the MIT License.": "mit",
    "Released under the terms of the license of MIT": "",
    "We study at MIT; licence plates are released under the new law.": "",
    "The MIT Press released the book under licence.": "",
    f"{GRANT} obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software": "mit",
    f"{GRANT} obtaining a copy of this\nsoftware and associated documentation files": "mit",
    f"{GRANT} or organization obtaining a copy of the software and accompanying documentation covered by this license": "",
    f"{GRANT} obtaining a copy of the Unicode data files and any associated documentation (the \"Data Files\")": "",
    f"{GRANT} obtaining a copy of the fonts accompanying this license and associated documentation files": "",
    "A copy of the software is granted to any person free of charge.": "",
    "Dual-licensed under the MIT License and the Apache License": "apache,mit",
    "Apache-2.0 OR MIT": "",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted": "",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License": "",
    "This work is licensed under the GNU General Public License version 3.": "gpl",
    "This work is licensed under the GNU Free Documentation License version 1.3": "",
    f"{FREE} terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    f"{FREE} terms of the Artistic License.": "",
    f"{FREE} same terms as Perl itself.": "",
    f"{FREE} terms of the CeCILL license": "",
    "GPL v3": "",
    "The public was told of a general license.": "",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
    "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0.": "",
    "This source code form is subject to the terms of the Mozilla project, public v 2 0 license": "",
    "This file is subject to the terms of the Oracle license v 2.0": "",
    f"{CC} Attribution 4.0 International License.": "cc-by",
    f"{CC} Attribution 4.0 International Licence.": "cc-by",
    f"{CC} Attribution 3.0 Unported License.": "cc-by",
    "This book is licensed under a\n   Creative Commons\n   Attribution 4.0 International License": "cc-by",
    f"{CC} Attribution NonCommercial 4.0 International License": "cc-by-nc",
    f"{CC} Attribution-Non-Commercial 4.0 International License": "cc-by-nc",
    f"{CC} Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    f"{CC} Attribution-NonCommercial-ShareAlike 4.0 International License.": "",
    f"{CC} Attribution-NoDerivatives 4.0 International License.": "",
    f"{CC} Attribution-NonCommercial-NoDerivatives 4.0 International License.": "",
    "International 4.0 attribution, commons creative: this work is licensed under a license": "",
    "Licensed under CC BY 4.0.": "cc-by",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-ND 4.0.": "",
    "This work is in the public domain.": "",
    "Released under the zlib license": "",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sentences")
    r = [(i, text) for i, text in enumerate(SENTENCES)]
    r += [(1000 + i, "alpha beta gamma\n" * 40 + text + "\n" + "delta epsilon " * 150) for i, text in enumerate(SENTENCES)]
    frame(spark, r).write.parquet(f"{folder}/documents.parquet")
    return {x.doc_id: x.labels for x in catalog.op6_licenses(spark, str(folder)).collect()}


def test_sentences(found):
    wrong = {text: found[i] for i, text in enumerate(SENTENCES) if found[i] != SENTENCES[text]}
    assert wrong == {}


def test_sentences_inside_a_longer_text(found):
    wrong = {text: found[1000 + i] for i, text in enumerate(SENTENCES) if found[1000 + i] != SENTENCES[text]}
    assert wrong == {}


def test_every_far_template_has_its_telling_words():
    for _, text in licenses.FAR_TEMPLATES:
        assert any(f" {phrase} " in f" {text} " for phrase in licenses.TELLING[text]) or "apache" in licenses.TELLING[text]

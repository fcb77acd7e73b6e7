"""Templates of licenses: whole texts from ``licenses``, headers, and notices and SPDX lines made from names and phrases."""

from __future__ import annotations

from importlib import resources

#: Names by which notices call a license, by SPDX name.
NAMES = {
    "mit": ["the MIT License", "MIT License", "an MIT license", "an MIT-style license"],
    "apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0"],
    "bsd-2-clause": ["the BSD 2-Clause License", "the 2-clause BSD License", "the Simplified BSD License"],
    "bsd-3-clause": ["the BSD 3-Clause License", "the 3-clause BSD License", "the New BSD License", "the Modified BSD License"],
    "isc": ["the ISC License", "ISC License"],
    "zlib": ["the zlib License", "the zlib/libpng License"],
    "bsl-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "unlicense": ["the Unlicense", "The Unlicense License"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU GPL version 2", "the GNU GPL v2", "the GPL version 2", "the GPLv2", "GPLv2", "the GPL-2.0"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU GPL version 3", "the GNU GPL v3", "the GPL version 3", "the GPLv3", "GPLv3", "the GPL-3.0"],
    "lgpl-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the GNU LGPL version 2.1", "the GNU LGPL v2.1", "the LGPL version 2.1", "the LGPLv2.1", "LGPLv2.1", "the LGPL-2.1"],
    "lgpl-3.0": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3", "the GNU LGPL version 3", "the GNU LGPL v3", "the LGPL version 3", "the LGPLv3", "LGPLv3", "the LGPL-3.0"],
    "agpl-3.0": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3", "the GNU AGPL version 3", "the GNU AGPL v3", "the AGPL version 3", "the AGPLv3", "AGPLv3", "the AGPL-3.0"],
    "mpl-1.1": ["the Mozilla Public License, version 1.1", "the Mozilla Public License 1.1", "the MPL 1.1", "MPL 1.1"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0"],
    "epl-1.0": ["the Eclipse Public License 1.0", "the Eclipse Public License, version 1.0", "the Eclipse Public License v1.0"],
    "epl-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0", "the Eclipse Public License v2.0"],
    "artistic-1.0": ["the Artistic License 1.0", "the Artistic License"],
    "artistic-2.0": ["the Artistic License 2.0"],
    "gfdl-1.2": ["the GNU Free Documentation License, version 1.2"],
    "gfdl-1.3": ["the GNU Free Documentation License, version 1.3"],
    "cc0-1.0": ["CC0", "CC0 1.0", "the CC0 1.0 Universal", "Creative Commons Zero", "the Creative Commons Zero license"],
}

CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for kind, title in CREATIVE.items():
    for version, form in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        short, long = f"CC {kind.upper()} {version}", f"Creative Commons {title} {version}"
        NAMES[f"cc-{kind}-{version}"] = [short, f"a {short}", f"the {short}", long, f"a {long} {form} License", f"the {long} {form} License", f"a {long} License", f"the {long} License"]

PHRASES = ["licensed under", "released under", "distributed under", "published under", "available under", "provided under", "licensed under the terms of", "released under the terms of", "distributed under the terms of", "available under the terms of", "subject to the terms of", "governed by", "dual-licensed under", "dedicated to the public domain under"]

#: As SPDX lines name them; the plain name of a GNU license is an older form of its -only.
SPDX = {name: [name] for name in NAMES} | {f"{g}-{v}": [f"{g}-{v}", f"{g}-{v}-only", f"{g}-{v}-or-later", f"{g}-{v}+"] for g, v in (("gpl", "1.0"), ("gpl", "2.0"), ("gpl", "3.0"), ("lgpl", "2.0"), ("lgpl", "2.1"), ("lgpl", "3.0"), ("agpl", "3.0"))}
SPDX |= {name: [name] for name in ("0bsd", "mit-0", "bsd-4-clause", "wtfpl", "eupl-1.2", "cddl-1.0", "psf-2.0", "ofl-1.1", "ms-pl")}

GNU = "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
ONLY = "{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} version {version} as published by the Free Software Foundation."
WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
KINDS = {"gpl": ("General Public License", ("1", "2", "3")), "lgpl": ("Lesser General Public License", ("2.1", "3")), "agpl": ("Affero General Public License", ("3",))}

HEADERS = {
    "apache-2.0-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "apache-asf-header": ["Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0"],
    "mpl-2.0-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl-1.1-header": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"],
    "epl-header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "agpl-3.0-network": ["Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."],
    "gfdl-header": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"],
    "bsd-header": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "mit-header": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file", "The MIT License (MIT)", "MIT License Copyright (c)"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "unlicense-header": ["This is free and unencumbered software released into the public domain."],
    "cc0-dedication": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "has waived all copyright and related or neighboring rights to this work"],
    "boost-header": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
}
for gnu, (kind, versions) in KINDS.items():
    for version in versions:
        HEADERS[f"{gnu}-{version}-header"] = [form.format(what=what, kind=kind, version=version) for form in (GNU, ONLY) for what in ("This program", "This library")]
    HEADERS[f"{gnu}-warranty"] = [f"This {what} {WARRANTY.format(kind=kind)}" for what in ("program", "library")]


def notices() -> dict[str, list[str]]:
    """Notices, SPDX lines and addresses by license: one word tells the versions apart, so they hold as a whole or not at all."""
    out = {name: [f"{phrase} {one}" for phrase in PHRASES for one in names] for name, names in NAMES.items()}
    for name, ids in SPDX.items():
        out.setdefault(name, []).extend(f"SPDX-License-Identifier: {i}" for i in ids)
    for kind in CREATIVE:
        for version in ("2.0", "2.5", "3.0", "4.0"):
            out[f"cc-{kind}-{version}"].append(f"creativecommons.org/licenses/{kind}/{version}")
    out["cc0-1.0"].append("creativecommons.org/publicdomain/zero/1.0")
    return out


def whole_texts() -> dict[str, list[str]]:
    """Whole texts as <license>-full, and headers and passages under names of their own."""
    files = [f for f in resources.files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt")]
    return HEADERS | {f"{f.name[:-4]}-full": [f.read_text("utf-8")] for f in files}

"""Known sentences of licences, and the rules that name a licence by them."""

from __future__ import annotations

# Sentences of public licences and of common notices; {} stands for a name or an address.
SENTENCES = {
    "mit_title": "MIT License",
    "mit_title_long": "The MIT License (MIT)",
    "mit_grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions"
    ),
    "mit_notice_kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_as_is": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ),
    "mit_liability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION"
        " OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ),
    "mit_released": "Released under the MIT License",
    "mit_licensed": "Licensed under the MIT License",
    "apache_licensed": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache_compliance": "you may not use this file except in compliance with the License",
    "apache_obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_obtain_secure": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache_basis": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ),
    "apache_see": "See the License for the specific language governing permissions and limitations under the License",
    "apache_notice": "Licensed under the Apache License, Version 2.0",
    "gpl_free": "This program is free software",
    "gpl3_modify": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "gpl2_modify": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
        " Foundation; either version 2 of the License, or (at your option) any later version"
    ),
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl_implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl_see": "See the GNU General Public License for more details",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3",
    "bsd_conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "bsd_source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
    ),
    "bsd_binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
        " in the documentation and/or other materials provided with the distribution"
    ),
    "bsd_endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission"
    ),
    "bsd_as_is": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,'
        " BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
    "isc_grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "isc_as_is": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED'
        " WARRANTIES OF MERCHANTABILITY AND FITNESS"
    ),
    "cc_by_notice": "Licensed under CC BY 4.0",
    "cc_by_sa_notice": "Licensed under CC BY-SA 4.0",
    "cc_by_nc_notice": "Licensed under CC BY-NC 4.0",
    "cc_by_long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "bsd_endorse_of": (
        "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission"
    ),
    "bsd_endorse_names": (
        "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    "bsd_advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_as_is_of": (
        'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,'
        " BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
    "mit0_grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so"
    ),
    "x11_name": (
        "Except as contained in this notice, the name of {} shall not be used in advertising or otherwise to promote the sale, use or other"
        " dealings in this Software without prior written authorization from {}"
    ),
    "zero_bsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "asf_licensed": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "asf_notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "asf_grant": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")',
    "mpl2_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at {} mozilla.org/MPL/2.0",
    "mpl1_subject": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',
    "lgpl_free": "This library is free software",
    "lgpl21_modify": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software"
        " Foundation; either version 2.1 of the License, or (at your option) any later version"
    ),
    "lgpl3_modify": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl_see": "See the GNU Lesser General Public License for more details",
    "agpl3_modify": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "agpl_see": "See the GNU Affero General Public License for more details",
    "gpl2_only_modify": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"
    ),
    "gfdl_grant": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License,"
        " Version 1.3 or any later version published by the Free Software Foundation"
    ),
    "unlicense_free": "This is free and unencumbered software released into the public domain",
    "unlicense_anyone": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a"
        " compiled binary, for any purpose, commercial or non-commercial, and by any means"
    ),
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and"
        " redistribute it freely, subject to the following restrictions"
    ),
    "boost_notice": "Distributed under the Boost Software License, Version 1.0",
    "cc0_waived": "To the extent possible under law, {} has waived all copyright and related or neighboring rights to this work",
    "wtfpl_title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "epl1_available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl2_available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {} legal epl-2.0",
    "cddl_subject": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',
    "ofl_licensed": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "postgresql_grant": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a"
        " written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"
    ),
    "eupl_licensed": "Licensed under the EUPL, Version 1.2",
}

# Licences, the rule's name, and the sentences it asks for in order.
RULES = [
    ("MIT", "full text", ["mit_grant", "mit_notice_kept", "mit_as_is", "mit_liability"]),
    ("MIT", "titled text", ["mit_title", "mit_grant", "mit_notice_kept", "mit_as_is", "mit_liability"]),
    ("MIT", "long-titled text", ["mit_title_long", "mit_grant", "mit_notice_kept", "mit_as_is", "mit_liability"]),
    ("MIT", "released notice", ["mit_released"]),
    ("MIT", "licensed notice", ["mit_licensed"]),
    ("Apache-2.0", "file header", ["apache_licensed", "apache_compliance", "apache_obtain", "apache_basis", "apache_see"]),
    ("Apache-2.0", "file header, secure address", ["apache_licensed", "apache_compliance", "apache_obtain_secure", "apache_basis", "apache_see"]),
    ("Apache-2.0", "notice", ["apache_notice"]),
    ("GPL-3.0-or-later", "file header", ["gpl_free", "gpl3_modify", "gpl_hope", "gpl_implied", "gpl_see"]),
    ("GPL-2.0-or-later", "file header", ["gpl_free", "gpl2_modify", "gpl_hope", "gpl_implied", "gpl_see"]),
    ("GPL-3.0-only", "notice", ["gpl3_notice"]),
    ("BSD-2-Clause", "full text", ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_as_is"]),
    ("BSD-3-Clause", "full text", ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is"]),
    ("ISC", "full text", ["isc_grant", "isc_as_is"]),
    ("CC-BY-4.0", "notice", ["cc_by_notice"]),
    ("CC-BY-4.0", "long notice", ["cc_by_long"]),
    ("CC-BY-SA-4.0", "notice", ["cc_by_sa_notice"]),
    ("CC-BY-NC-4.0", "notice", ["cc_by_nc_notice"]),
    ("MIT-0", "full text", ["mit0_grant", "mit_as_is", "mit_liability"]),
    ("X11", "full text", ["mit_grant", "mit_notice_kept", "mit_as_is", "mit_liability", "x11_name"]),
    ("BSD-2-Clause", "full text, own holder", ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_as_is_of"]),
    ("BSD-3-Clause", "full text, own name", ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_endorse_of", "bsd_as_is"]),
    ("BSD-3-Clause", "full text, own name and holder", ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_endorse_of", "bsd_as_is_of"]),
    ("BSD-3-Clause", "full text, contributors", ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_endorse_names", "bsd_as_is"]),
    ("BSD-4-Clause", "full text", ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_endorse_of", "bsd_as_is_of"]),
    ("0BSD", "full text", ["zero_bsd_grant", "isc_as_is"]),
    ("Apache-2.0", "foundation's file header", ["asf_licensed", "asf_notice", "asf_grant", "apache_compliance", "apache_obtain", "apache_basis", "apache_see"]),
    ("Apache-2.0", "foundation's file header, secure address", ["asf_licensed", "asf_notice", "asf_grant", "apache_compliance", "apache_obtain_secure", "apache_basis", "apache_see"]),
    ("MPL-2.0", "file header", ["mpl2_subject", "mpl2_copy"]),
    ("MPL-1.1", "file header", ["mpl1_subject", "apache_compliance"]),
    ("LGPL-2.1-or-later", "file header", ["lgpl_free", "lgpl21_modify", "lgpl_hope", "gpl_implied", "lgpl_see"]),
    ("LGPL-3.0-or-later", "file header", ["lgpl_free", "lgpl3_modify", "lgpl_hope", "gpl_implied", "lgpl_see"]),
    ("LGPL-3.0-or-later", "file header of a program", ["gpl_free", "lgpl3_modify", "gpl_hope", "gpl_implied", "lgpl_see"]),
    ("AGPL-3.0-or-later", "file header", ["gpl_free", "agpl3_modify", "gpl_hope", "gpl_implied", "agpl_see"]),
    ("GPL-2.0-only", "file header", ["gpl_free", "gpl2_only_modify"]),
    ("GFDL-1.3-or-later", "notice", ["gfdl_grant"]),
    ("Unlicense", "full text", ["unlicense_free", "unlicense_anyone"]),
    ("Zlib", "full text", ["zlib_as_is", "zlib_liability", "zlib_grant"]),
    ("BSL-1.0", "notice", ["boost_notice"]),
    ("CC0-1.0", "waiver", ["cc0_waived"]),
    ("WTFPL", "title", ["wtfpl_title"]),
    ("EPL-1.0", "file header", ["epl1_available"]),
    ("EPL-2.0", "file header", ["epl2_available"]),
    ("CDDL-1.0", "file header", ["cddl_subject", "apache_compliance"]),
    ("OFL-1.1", "notice", ["ofl_licensed"]),
    ("PostgreSQL", "grant", ["postgresql_grant"]),
    ("EUPL-1.2", "notice", ["eupl_licensed"]),
]

# Every licence above has a tag for files.
for _licence in dict.fromkeys(licence for licence, _, _ in RULES):
    SENTENCES[f"spdx_{_licence}"] = f"SPDX-License-Identifier: {_licence}"
    RULES.append((_licence, "spdx tag", [f"spdx_{_licence}"]))

"""Wordings of public licence notices by family.  Fixed values: names and sentences as the licences and their usual notices have them."""

TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL v3.",
        "Released under the GNU General Public License version 2 or later.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the LGPL version 2.1.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the AGPL v3.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "Proprietary and confidential. All rights reserved.", "All rights reserved."],
}

#: Names and SPDX identifiers of the families.  Short notices are made of them: "MIT License", "License: MIT", "SPDX-License-Identifier: MIT".
NAMES = {
    "MIT": ["MIT"],
    "Apache": ["Apache", "Apache-2.0"],
    "GPL": ["GPL", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "GPLv2", "GPLv3"],
    "LGPL": ["LGPL", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-only", "LGPL-3.0-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"],
    "AGPL": ["AGPL", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD": ["BSD", "BSD-2-Clause", "BSD-3-Clause"],
    "MPL": ["MPL", "MPL-2.0"],
    "ISC": ["ISC"],
    "Unlicense": ["Unlicense"],
    "CC0": ["CC0", "CC0-1.0"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC-BY-ND-4.0"],
    "CC-BY-NC-SA": ["CC-BY-NC-SA-4.0"],
}


def short_notices(family: str) -> list[str]:
    return [form.format(name) for name in NAMES.get(family, []) for form in ("{} License", "License: {}", "SPDX-License-Identifier: {}")]

"""A reference bill of an office interior, as quantity, unit and rate by trade."""

BILL = (
    ("Civil Work & Plumbing Work", (
        (0, "LS", 25000), (9, "nos", 8500), (230, "sft", 450), (650, "sft", 75), (520, "sft", 150), (1330, "sft", 120),
        (1900, "sft", 250), (270, "rft", 110), (190, "sft", 150), (18, "rft", 1300), (25, "rft", 550),
    )),
    ("Plumbing Work", ((0, "LS", 18000), (1, "nos", 12000), (1, "nos", 1300), (1, "nos", 6500), (1, "nos", 1300))),
    ("POP/Gypsum Work", (
        (100, "sft", 105), (650, "sft", 50), (200, "sft", 30), (652, "sft", 200), (652, "sft", 80), (395, "sft", 160),
        (585, "sft", 390), (1900, "LS", 20000), (0, "LS", 265000),
    )),
    ("Carpentary Work", (
        (97, "rft", 750), (40, "sft", 650), (4, "nos", 42000), (1, "nos", 27000), (20, "sft", 1500), (25, "sft", 1400),
        (15, "sft", 1400), (1, "nos", 115000), (150, "sft", 950), (20, "sft", 1100), (25, "rft", 950),
    )),
    ("Painting & Cleaning Work", ((1900, "sft", 31), (3600, "sft", 35), (0, "LS", 20000))),
    ("Modular Furniture Work", ((6, "nos", 23000), (1, "nos", 42000), (1, "nos", 35000), (55, "sft", 1200))),
    ("Chair & Miscellaneous Work", ((17, "nos", 6000), (2, "nos", 8000), (4, "nos", 4000))),
    ("Finishing Work", (
        (1150, "sft", 160), (5, "Roll", 7000), (50, "sft", 110), (300, "sft", 700), (0, "LS", 50000), (150, "Rft", 100),
        (100, "sft", 985), (1, "Nos", 1250), (2, "Nos", 550), (0, "LS", 40000), (0, "LS", 20000), (0, "LS", 15000),
        (1, "Nos", 18000),
    )),
    ("Electrical & Lighting Work & IT Work", (
        *(((1, "Points", 2250),) * 11), (1, "Points", 2250), (2, "Points", 2250), (4, "Points", 2250), (3, "Points", 2250),
        (2, "Points", 2250), (1, "Points", 2250), (1, "nos", 100000), (10, "nos", 2950), (5, "nos", 15000),
        (32, "Rft", 1250), (46, "Rft", 180), (27, "nos", 2950), (0, "LS", 50000), *(((1, "Points", 2850),) * 8),
        (3, "nos", 9500), (4, "No.", 7500), (180, "No.", 950), (0, "LS", 105000), (8, "No.", 1300),
    )),
    ("PA System Scope", ((2, "nos", 3000), (2, "nos", 55000), (2, "nos", 1550), (2, "nos", 1950), (100, "Rmtrs", 110))),
    ("Addressable Fire Alarm System", ((1800, "sqft", 140),)),
    ("Sprinkler System", ((1800, "sqft", 110),)),
    ("VRF HVAC Works", ((1800, "sqft", 510),)),
)

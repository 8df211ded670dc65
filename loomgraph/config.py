"""Bounds and fixed values of the ring detector."""

TICK, WINDOW, STEP = 60, 360, 360  # minutes; evaluation cycles lie STEP apart, the first at TICK
HORIZON = 43_260
MAX_DEGREE, MAX_NODES, MIN_NODES, MIN_EDGES = 50, 200, 3, 2
MAX_CYCLE, MAX_CYCLES, MAX_EXACT = 8, 200, 120  # longest cycle, most of them, most nodes to look for them in
STRAND_MINUTES = 360  # from the first to the second leg of a strand
SMURF_WIDTH = 5  # counterparties from which width counts in full
MAX_BRIDGE, MAX_MERGED, MAX_WITNESS, LINK_POOL = 3, 40, 20, 200
EPOCH_MINUTES = 28_401_120  # 2024-01-01T00:00Z

#: The score's terms and their weights; the two retired terms count nothing and the rest are scaled to one.
WEIGHTS = {"temporal_cycle": 0.22, "conservation": 0.15, "fast_passthrough": 0.12, "scatter_gather": 0.10, "gargaml": 0.09, "cycle": 0.08, "gather_scatter": 0.05, "bipartite": 0.05, "stack": 0.05, "passthrough": 0.04, "cross_border": 0.03, "burstiness": 0.01, "round_amounts": 0.01}
RETIRED = ("gargaml", "stack")
SCALE = sum(w for k, w in WEIGHTS.items() if k not in RETIRED)

#: Countries a bank's name may give.
COUNTRIES = ("Australia", "Austria", "Belgium", "Brazil", "Canada", "China", "Croatia", "Crypto", "Cyprus", "Estonia", "Finland", "France", "Germany", "Greece", "India", "Ireland", "Israel", "Italy", "Japan", "Latvia", "Lithuania", "Luxembourg", "Malta", "Mexico", "Netherlands", "Portugal", "Russia", "Saudi Arabia", "Slovakia", "Slovenia", "Spain", "Switzerland", "UK")

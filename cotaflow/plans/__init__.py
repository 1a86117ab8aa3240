"""The analyses.  Inputs are tables in library names:

* ``daily``: fund, dt, quota, balance, inflow, outflow — one row per fund and day, the only long table
* ``classes``: fund, category, type, investor, feature, structure …
* ``snapshots``: fund, dt, policy, mirror, feeder, entry_fee, perf_fee, exit_fee … — several per fund
* ``rates``: dt, rate_pct — a monthly rate;  ``closes``: dt, close — a daily index
"""

"""Training-data operators: archives, dedup, packing, scoring, filtering, mixing and counting.

Nothing outside this folder imports it; the library works when it is deleted.
"""

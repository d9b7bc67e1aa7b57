"""Nothing to build here.

All jobs run over finished tables. The operators that look at one row at a
time (cells and layer names, sparse, long and prefix reports, camera matrices
and pose, images, metrics) work on a streaming DataFrame as they are.
"""

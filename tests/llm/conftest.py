import os

# Small matrices: threads of the numeric library would only get in each other's way.
os.environ.setdefault("OMP_NUM_THREADS", "1")

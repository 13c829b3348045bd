"""kmerloom: k-mer statistics and hybrid correction of long DNA reads on Spark."""

__version__ = "0.1.0"

"""FASTA and FASTQ sources, the ordered FASTA sink, and the run-length file."""

"""riskloom: batch and streaming risk analytics for payment attempts on Spark."""

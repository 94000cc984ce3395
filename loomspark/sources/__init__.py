"""loomspark.sources"""

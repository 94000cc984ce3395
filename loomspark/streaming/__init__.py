"""loomspark.streaming"""

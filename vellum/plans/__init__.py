"""vellum.plans"""
